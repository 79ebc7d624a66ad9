"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each document has a fixed 48-bit hash. Its source's sizes are summed by the hash's leading bits; the bucket in
which the running sum crosses the budget is refined by the next bits, and so on, until the threshold is one hash
value. Documents below the threshold are taken: nothing is sorted but the histograms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import store
from .registry import query
from .tables import Rows, documents, keyed

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
LEVEL_BITS = 12
LEVELS = 4
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) for (source, source_size), one row per source.

    Targets are proportional to the sources' weights and sum to ``share`` of all sizes; none exceeds
    ``repeats`` times its source. The excess goes to the others by weight, so there is one level L with
    target = min(repeats * size, L * weight); it is found among the sources in the order in which they reach
    their limit. The window holds one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = (F.col("source_size") * repeats).cast("double")
    weighed = sizes.withColumn("_w", weight).withColumn("_limit", limit).withColumn("_at", F.col("_limit") / F.col("_w"))
    everything = Window.partitionBy()
    earlier = Window.orderBy("_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    )
    # The first source that stays under its own limit, as if all before it were at theirs and none after, sets the level.
    found = weighed.withColumn("_level", level)
    free = F.when(F.col("_level") <= F.col("_at"), F.struct("_at", F.col("source").isNull().alias("_n"), "source", "_level"))
    target = F.least(F.col("_limit"), F.coalesce(F.min(free).over(everything)["_level"] * F.col("_w"), F.col("_limit")))
    return found.select("source", "source_size", target.alias("target"))


def mix_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    level_bits: int = LEVEL_BITS,
    levels: int = LEVELS,
) -> DataFrame:
    """(rid, doc_id, size, source_size, target, taken, times): how many words of each row the mix takes, and how often.

    A size is the number of words, 0 for a null or blank text. A source whose target is t times its size takes
    each document floor(t) times, and once more those whose hash lies below the source's threshold; the
    threshold is the one whose sum is nearest to what is left of the target. The hash is the md5 of the
    doc_id, so reruns agree; rows with equal ids are taken together. A null source is a source of its own,
    last in order. Sources without words have target 0. Other columns are ignored; an empty table gives no
    rows. A hot source is a total like any other: sums are combined before they are shuffled.
    """
    return _mixed(keyed(docs, "doc_id", "source", "text"), weights, share, repeats, level_bits, levels)


def _mixed(
    rows: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    level_bits: int = LEVEL_BITS,
    levels: int = LEVELS,
) -> DataFrame:
    """``mix_documents`` of rows (rid, doc_id, source, text)."""
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("bigint")
    if levels * level_bits != 48:
        raise ValueError("levels * level_bits must be 48, the bits of the hash")
    rows = store(rows.select("rid", "doc_id", "source", words("text").alias("size"), number.alias("hash")), "word-counts")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    state = source_targets(sizes, weights, share, repeats).withColumn("copies", copies)
    left = F.col("target") - F.col("copies") * F.col("source_size")
    # prefix: the boundary bucket so far; below: sizes under it.
    state = store(state.select("*", left.alias("budget"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("below")), "mix-0")
    for level in range(levels):
        shift = 48 - level_bits * (level + 1)
        here = state.select(F.col("source").alias("_s"), "prefix", "below", "budget")
        inside = rows.join(here, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", shift + level_bits) == F.col("prefix")))
        histogram = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("n"), F.first("below").alias("below"), F.first("budget").alias("budget")
        )
        upto = Window.partitionBy("source").orderBy("bucket")
        running = histogram.withColumn("upto", F.col("below") + F.sum("n").over(upto))
        # The boundary is the first bucket that reaches the budget.
        edge = (
            running.filter(F.col("upto") >= F.col("budget"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("below"), "upto")).alias("edge"))
            .select(F.col("source").alias("_s"), "edge")
        )
        state = store(
            state.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "target", "copies", "budget",
                F.coalesce("edge.bucket", F.lit(-1)).cast("bigint").alias("prefix"),
                F.coalesce("edge.below", "below").alias("below"),
                F.coalesce("edge.upto", "below").alias("upto"),
            ),
            f"mix-{level + 1}",
        )
    nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("below"))
    threshold = F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix"))
    cut = state.select(F.col("source").alias("_s"), "source_size", "target", "copies", threshold.alias("threshold"))
    times = F.col("copies") + (F.col("hash") < F.col("threshold")).cast("bigint")
    return rows.join(cut, F.col("source").eqNullSafe(F.col("_s"))).select(
        "rid", "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.cast("int").alias("times")
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """``docs``, each row as many times as the mix takes it; all columns stay."""
    columns, rows = docs.columns, Rows(docs)
    times = _mixed(rows.keyed("doc_id", "source", "text")).select("rid", F.array_repeat(F.lit(True), F.col("times")).alias("times")).filter(F.size("times") > 0)
    name = "_taken" + "_" * max((len(c) for c in columns), default=0)
    repeated = rows.join(times.withColumnRenamed("times", name)).withColumn(name, F.explode(name))
    return repeated.drop(name)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w,
         CAST(2 * source_size AS DOUBLE) AS lim FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER ()
             - coalesce(sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
  FROM w
), f AS (
  SELECT min_by(lev, rn) AS lev
  FROM (SELECT lev, row_number() OVER (ORDER BY lim / w, source NULLS LAST) AS rn, lev <= lim / w AS free FROM l) WHERE free
), t AS (
  SELECT source, source_size, least(lim, coalesce(f.lev * w, lim)) AS target FROM l LEFT JOIN f ON true
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t
), h AS (
  SELECT d.source, h, sum(size) AS n FROM d GROUP BY d.source, h
), r AS (
  SELECT h.source, h.h, n, sum(n) OVER (PARTITION BY h.source ORDER BY h.h) AS upto,
         b.target - b.copies * b.source_size AS budget
  FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source
), e AS (
  SELECT source, min(h) AS h, min_by(upto - n, h) AS below, min_by(upto, h) AS upto, any_value(budget) AS budget
  FROM r WHERE upto >= budget GROUP BY source
), c AS (
  SELECT b.*, CASE WHEN e.h IS NULL THEN -1 WHEN e.upto - e.budget < e.budget - e.below THEN e.h + 1 ELSE e.h END AS threshold
  FROM b LEFT JOIN e ON b.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN h < threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""


@query("op9_hash_thresholds", ORACLE)
def op9_hash_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir)).drop("rid", "times")

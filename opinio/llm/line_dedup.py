"""Deduplication of line runs by a suffix array over line numbers, built by distributed prefix doubling.

Each line gets a number. The rank of a suffix by its first line is that number's place; ranks by 2, 4, 8, ... lines
come from sorting the pairs (rank here, rank as many lines further on). Suffixes whose rank is their own are settled and
leave, so each round works on what still repeats. Suffixes of one rank after k rounds are an interval of the
suffix array whose longest common prefix is at least 2**k lines; all but its first one, in document order, are
later copies of these lines. A maximal repeated run is the union of such stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import store
from .registry import query
from .tables import documents, numbered_rows

MIN_WORDS = 5


def _ranked(keys: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Distinct ``keys`` with an increasing number ``rank`` in the order of ``columns`` (with gaps between tasks)."""
    return store(keys.orderBy(*columns).withColumn("rank", F.monotonically_increasing_id()), f"ranks-{k}")


def repeated_prefixes(lines: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: (doc_id, rid, pos, rank, later) of the suffixes whose first 2**k lines occur more than once.

    ``lines`` is a stored table (doc_id, rid, pos, line), ``line`` being any sortable identity. Suffixes with
    equal first 2**k lines have equal ranks, and ranks are in their order; ``later`` is false for the first
    of them in the order of doc_id, rid and pos.
    """
    rounds, columns, current = [], ["line"], lines
    while True:
        k = len(rounds)
        first = F.min(F.struct("doc_id", "rid", "pos")).alias("first")
        repeated = current.groupBy(*columns).agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")
        ranks = _ranked(repeated, columns, k)
        found = current.join(ranks, columns).select(
            "doc_id", "rid", "pos", "rank", ((F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos"))).alias("later")
        )
        found = store(found, f"prefixes-{k}")
        if found.limit(1).count() == 0:
            return rounds
        rounds.append(found)
        step = 1 << k
        onward = Window.partitionBy("rid").orderBy("pos").rangeBetween(step, step)
        pairs = found.withColumn("next", F.max("rank").over(onward)).filter("next is not null")
        current, columns = store(pairs.select("doc_id", "rid", "pos", F.col("rank").alias("here"), "next"), f"pairs-{k}"), ["here", "next"]


def removed_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, pos) of the lines that are part of a later copy, for rows (rid, doc_id, text)."""
    split = rows.select("rid", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "content"))
    identity = F.struct(F.xxhash64("content").alias("a"), F.crc32(F.col("content").cast("binary")).alias("b"), F.length("content").alias("c"))
    words = F.regexp_count("content", F.lit(r"\S+"))
    lines = store(split.select("doc_id", "rid", "pos", identity.alias("line"), (words >= min_words).alias("long")), "lines")
    rounds = repeated_prefixes(lines.drop("long"))
    if not rounds:
        return lines.filter("false").select("rid", "pos")
    # One line alone must be long; a run of two or more lines counts whatever their lengths.
    single = rounds[0].join(lines.select("rid", "pos", "long"), ["rid", "pos"]).select(
        "rid", "pos", F.when(F.col("later") & F.col("long"), F.col("pos") + 1).otherwise(0).alias("reach")
    )
    marks = single
    for k, found in enumerate(rounds[1:], 1):
        marks = marks.unionByName(found.filter("later").select("rid", "pos", (F.col("pos") + (1 << k)).alias("reach")))
    per_line = marks.groupBy("rid", "pos").agg(F.max("reach").alias("reach"))
    so_far = Window.partitionBy("rid").orderBy("pos")
    return per_line.withColumn("reach", F.max("reach").over(so_far)).filter("reach > pos").select("rid", "pos")


def remove_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, doc_id, n_lines, n_removed, n_runs, text): every row of ``docs`` with what is left of its text.

    Lines end at line feeds. A run of lines that occurred before, in the order of doc_id and place, is removed
    if it has at least two lines, or is one line of at least ``min_words`` words; the first copy stays.
    ``n_runs`` counts the separate stretches removed. A null text counts as empty, one empty line; rows with a
    null doc_id come first; repeated rows are copies like any others. If no line is left the text is empty. An
    empty table gives no rows; other columns are ignored.
    """
    rows = numbered_rows(docs, "doc_id", "text")
    gone = store(removed_lines(rows, min_words).groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "removed")
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # A merge join at every size: the list of removals grows with the corpus and is not for broadcasting.
    both = rows.join(gone.hint("merge"), "rid", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # Slices between removed lines; a lookup of each line among the removed would be quadratic.
    bounds = F.concat(F.array(F.lit(-1)), "gone")
    ends = F.concat("gone", F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(bounds, ends, lambda a, b: F.slice(F.col("lines"), a + 2, b - a - 1)))
    starts = F.size(F.filter(F.zip_with("gone", F.concat(F.array(F.lit(-2)), "gone"), lambda a, b: a - b), lambda d: d > 1))
    whole = both.withColumn("lines", split)
    return whole.select(
        "rid",
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size("gone").cast("bigint").alias("n_removed"),
        starts.cast("bigint").alias("n_runs"),
        F.array_join(kept, "\n").alias("text"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), n AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt, len(regexp_extract_all(line, '[^\s\x0B]+')) AS words FROM l
), m AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AND words >= 5 AS one,
         nxt IS NOT NULL AND row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, pos) > 1 AS two FROM n
), g AS (
  SELECT doc_id, pos, line, one OR two OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM m
), r AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM g
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM r GROUP BY doc_id
"""


@query("op8_suffix_array", ORACLE)
def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_runs(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("text_sha256"))

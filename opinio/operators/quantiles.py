"""Exact quantiles of large groups by histograms of ever longer bit prefixes of the values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import store

STEP = 16  # bits that a round settles; a histogram has at most 2**STEP rows for each prefix still open


def ordered_bits(value: str | Column) -> Column:
    """The bits of a double as a long that sorts like the value: NaN last, both zeros equal, null stays null."""
    number = (F.col(value) if isinstance(value, str) else value).cast("double") + F.lit(0.0)
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), number).cast("bigint")
    return F.when(number.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits))


def from_ordered_bits(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(key)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], named: Mapping[str, str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[named[k]])
    return on


def exact_quantiles(df: DataFrame, value: str, quantiles: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, one double per name): exact linear-interpolated quantiles of the non-null values, as ``percentile`` has them.

    Each round counts rows by group and the next 16 bits of the value's ordered form, only among rows whose leading
    bits are those of a wanted rank, and finds the 16 bits in which the rank falls; after four rounds the value is known.
    Tasks combine counts before the shuffle, so no group sends more than 65,536 counts per wanted rank and round and
    no task ever holds the distinct values of a group. Groups without a value are absent; a null group is a group.
    With no ``by`` an empty table gives one row of nulls with ``n`` 0. Results do not depend on the partitioning.
    """
    keys = list(by)
    if not quantiles or any(not 0 <= p <= 1 for p in quantiles.values()):
        raise ValueError("quantiles must lie between 0 and 1")
    names = {k: f"_g{i}" for i, k in enumerate(keys)}
    group = list(names.values())
    rows = df.select(*[F.col(k).alias(g) for k, g in names.items()], ordered_bits(value).alias("_key"))
    rows = store(rows.filter(F.col("_key").isNotNull()), "quantiles")
    own = {g: f"{g}o" for g in group}

    def place(p: float) -> Column:
        return (F.col("_n") - 1) * F.lit(float(p))

    sides = [f(place(p)).cast("bigint") for p in quantiles.values() for f in (F.floor, F.ceil)]
    totals = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    wanted, bits = None, 64
    while bits > 0:
        # Rows that share the leading bits of an open prefix; in the first round, all of them.
        bits -= STEP
        head = F.lit(0).cast("bigint") if wanted is None else F.shiftright("_key", bits + STEP)
        counts = rows.select(*group, head.alias("_at"), F.shiftright("_key", bits).alias("_next"))
        if wanted is not None:
            asked = wanted.select(*[F.col(g).alias(own[g]) for g in group], F.col("_at").alias("_p"), "_ranks")
            counts = counts.join(asked, _same(counts, asked, group, own) & (counts["_at"] == asked["_p"]), "left_semi")
        counts = counts.groupBy(*group, "_at", "_next").agg(F.count("*").alias("_c"))
        prefix = Window.partitionBy(*group, "_at")
        upto = F.sum("_c").over(prefix.orderBy("_next").rowsBetween(Window.unboundedPreceding, 0))
        steps = counts.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("_c"))
        if wanted is None:
            met = steps.withColumn("_n", F.sum("_c").over(prefix)).withColumn("_ranks", F.array_distinct(F.array(*sides)))
        else:
            met = steps.join(asked, _same(steps, asked, group, own) & (steps["_at"] == asked["_p"]))
        # Ranks count from 0 inside the prefix; where a prefix holds the ranks r, they go on as r - rows below.
        hits = F.filter("_ranks", lambda r: (_rank(r, bits) >= F.col("_below")) & (_rank(r, bits) < F.col("_upto")))
        moved = F.transform(hits, lambda r: _moved(r, bits, F.col("_below")))
        wanted = met.select(*group, F.col("_next").alias("_at"), moved.alias("_ranks")).filter(F.size("_ranks") > 0)
        wanted = store(wanted, "quantile-prefixes")
    found = wanted.select(*group, F.explode("_ranks").alias("_r"), from_ordered_bits(F.col("_at")).alias("_v"))
    value_at = F.map_from_entries(F.collect_list(F.struct(F.col("_r.first"), F.col("_v"))))
    values = found.groupBy(*group).agg(value_at.alias("_values"))
    if keys:
        theirs = values.select(*[F.col(g).alias(own[g]) for g in group], "_values")
        both = totals.join(theirs, _same(totals, theirs, group, own))
    else:
        both = totals.withColumn("_values", values.select("_values").scalar())
    out = []
    for name, p in quantiles.items():
        low, high = F.floor(place(p)).cast("bigint"), F.ceil(place(p)).cast("bigint")
        below, above = F.col("_values")[low], F.col("_values")[high]
        between = (high - place(p)) * below + (place(p) - low) * above
        out.append(F.when((low == high) | (below == above), below).otherwise(between).alias(name))
    return both.select(*[F.col(g).alias(k) for k, g in names.items()], F.col("_n").alias("n"), *out)


def _rank(r: Column, bits: int) -> Column:
    """A wanted rank inside its prefix: a plain number in the first round, then (first, rank)."""
    return r if bits + STEP == 64 else r["rank"]


def _moved(r: Column, bits: int, below: Column) -> Column:
    first = r if bits + STEP == 64 else r["first"]
    return F.struct(first.alias("first"), (_rank(r, bits) - below).alias("rank"))

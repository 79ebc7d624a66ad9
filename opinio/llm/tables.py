"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import store

NAME_BUCKETS = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """The chosen columns under a row number ``rid``, so repeated or null keys stay separate rows.

    Row numbers follow the scan, whose splits may differ the next time even on the same files: store what is
    derived from them in one go, or use ``numbered_rows`` where rows are read again.
    """
    return df.select(F.monotonically_increasing_id().alias("rid"), *columns)


def numbered_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``keyed``, stored: every reader finds the same number on the same row."""
    return store(keyed(docs, *columns), "rows")


class Rows:
    """``docs`` stored once with a row number, under a name that clashes with no column."""

    def __init__(self, docs: DataFrame):
        self.columns, self.key = docs.columns, "_rid"
        while self.key.lower() in (c.lower() for c in docs.columns):
            self.key += "_"
        self.table = store(docs.withColumn(self.key, F.monotonically_increasing_id()), "rows")

    def keyed(self, *columns: str) -> DataFrame:
        """The chosen columns and the row number ``rid``."""
        return self.table.select(F.col(self.key).alias("rid"), *columns)

    def join(self, decided: DataFrame, how: str = "inner") -> DataFrame:
        """The rows, all their columns first, joined with ``decided`` on its ``rid``, whose other columns must not clash."""
        return self.table.join(decided.withColumnRenamed("rid", self.key), self.key, how).drop(self.key)


def least_by_hash(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those whose ``keys`` have the least hash.

    A first cut at the hash below which about ``n`` rows are expected (six deviations more are let in) keeps the
    tasks from sending ``n`` rows each.
    """
    hashed = F.xxhash64(*keys)
    share = (n + 6 * math.sqrt(n)) / max(1, df.count())
    if share < 1:
        df = df.filter(hashed < -(1 << 63) + int(share * (1 << 64)))
    return df.orderBy(hashed, *keys).limit(n)


def numbered(df: DataFrame, key: Column, order: list[str], name: str) -> DataFrame:
    """Distinct rows of ``df`` with an integer ``name``, equal for equal rows only.

    Rows are dealt to many buckets by ``key`` and sorted inside each, so no task sorts the whole table; the
    name is the bucket and the rank in it.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(NAME_BUCKETS)).alias("_bucket")
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*order))
    return df.select("*", bucket).withColumn(name, F.shiftleft(F.col("_bucket"), 40) + rank).drop("_bucket")


def numbered_slots(df: DataFrame, group: str, order: list[str], slot: str, rows_per_task: int = 50_000) -> DataFrame:
    """``df`` (a stored table) with a gapless number from 0 in each ``group``.

    Hot groups are cut: rows are dealt to buckets by hash, numbered there, and shifted by the rows of the
    group in earlier buckets, so no task holds a group.
    """
    buckets = max(64, math.ceil(df.count() / rows_per_task))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(
        dealt.groupBy(group, "_b").count().select(group, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")),
        "starts",
    )
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)) - 1
    ranked = dealt.withColumn("_in", inside)
    return ranked.join(starts, [group, "_b"]).withColumn(slot, (F.col("_start") + F.col("_in")).cast("bigint")).drop("_b", "_in", "_start")

"""Reproducible splits by key hash: the same row falls on the same side on every run and cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import hashing


def train_test_split(df: DataFrame, id: str, test_pct: int = 20) -> DataFrame:
    """Adds ``split``: test for ``test_pct`` percent of the keys, train for the others."""
    bucket = hashing.hash_bucket(100, id)
    return df.withColumn("split", F.when(bucket < test_pct, "test").otherwise("train"))


def train_val_test_split(df: DataFrame, id: str, test_pct: int = 20, val_pct: int = 15) -> DataFrame:
    """Adds ``split``: the training side is split once more, by an independent hash, for validation."""
    outer = hashing.hash_bucket(100, id)
    inner = hashing.hash_bucket(100, F.lit("val"), id)
    return df.withColumn(
        "split", F.when(outer < test_pct, "test").when(inner < val_pct, "val").otherwise("train")
    )


def kfold(df: DataFrame, id: str, k: int = 5) -> DataFrame:
    return df.withColumn("fold", hashing.hash_bucket(k, id).cast("int"))


def class_weights(df: DataFrame, label: str = "label", y: str = "y_true") -> DataFrame:
    """(label, y_true, n, weight): balanced weight n / (2 * n_class) per label and class."""
    counts = df.groupBy(label, y).agg(F.count("*").alias("n"))
    totals = df.groupBy(label).agg(F.count("*").alias("_total"))
    return counts.join(totals, label).select(
        label, y, "n", F.round(F.col("_total") / (2.0 * F.col("n")), 6).alias("weight")
    )

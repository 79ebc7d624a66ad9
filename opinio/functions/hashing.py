"""Stable pseudo-random values from keys: equal on every run, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_number(*keys: str | Column) -> Column:
    """32-bit number from the md5 of the keys joined by ``:``."""
    joined = F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def hash_bucket(modulus: int, *keys: str | Column) -> Column:
    return hash_number(*keys) % modulus

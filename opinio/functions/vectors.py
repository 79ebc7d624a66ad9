"""Expressions on array<float|double> vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: str | Column) -> Column:
    squares = F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def l2_normalize(v: str | Column) -> Column:
    """Unit-length vector; the zero vector stays zero. The length is bound once, not once per element."""
    lengths = F.array(F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0)))
    return F.transform(lengths, lambda n: F.transform(_col(v), lambda x: x.cast("double") / n))[0]


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity, 0 when either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))

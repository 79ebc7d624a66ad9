"""Turning array cells into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_rows(df: DataFrame, array: str | Column, name: str, *keep: str | Column) -> DataFrame:
    """One row per non-null element of ``array``, next to the kept columns.

    Same rows as a plain explode. A plain explode makes the optimiser test ``size(array) > 0`` as a filter at
    the scan, which evaluates a costly array expression (tokenising a text) a second and third time; the outer
    form with a test on its output does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, array: str | Column, position: str, name: str, *keep: str | Column) -> DataFrame:
    """The same with the position, from 0."""
    return df.select(*keep, F.posexplode_outer(array).alias(position, name)).filter(F.col(name).isNotNull())

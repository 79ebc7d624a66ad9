"""Date column expressions; a value that is no date becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed_values import SEASONS
from .text import blank_to_null


def normalize_date(c: str | Column) -> Column:
    """Date of an ISO or day-first text, its time and zone cut off."""
    text = F.regexp_replace(blank_to_null(c), "/", "-")
    day = F.split_part(F.split_part(text, F.lit("+"), F.lit(1)), F.lit(" "), F.lit(1))
    iso = F.when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(day, "yyyy-M-d"))
    local = F.when(day.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(day, "d-M-yyyy"))
    return F.coalesce(iso, local)


def date_parts_text(c: str | Column) -> Column:
    """Struct(day, month, year) by cutting the text at blanks and dashes; all null unless all three are whole numbers."""
    text = F.col(c) if isinstance(c, str) else c
    parts = F.split(F.split_part(text, F.lit(" "), F.lit(1)), "-")
    year, month, day = (F.get(parts, F.lit(i)).try_cast("int") for i in range(3))
    whole = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.struct(
        F.when(whole, day).alias("day"), F.when(whole, month).alias("month"), F.when(whole, year).alias("year")
    )


def date_parts(c: str | Column) -> Column:
    """Struct(day, month, year) of a date."""
    return F.struct(F.dayofmonth(c).alias("day"), F.month(c).alias("month"), F.year(c).alias("year"))


def season(month: str | Column) -> Column:
    """Season name of a month number; December stays in its calendar year."""
    month = F.col(month) if isinstance(month, str) else month
    result = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        result = F.when(month.isin(months), F.lit(name)).otherwise(result)
    return result


def quarter_label(c: str | Column) -> Column:
    """Text such as 2020Q1."""
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def order_gap_days(date: str | Column, order_date: str | Column) -> Column:
    """Days from order to review."""
    return F.datediff(date, order_date).cast("double")

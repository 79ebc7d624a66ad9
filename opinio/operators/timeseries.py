"""Counts of reviews over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates
from . import profile


def with_date_parts(df: DataFrame, date: str = "review_date") -> DataFrame:
    parts = dates.date_parts(date)
    return df.withColumns(
        {"day": parts["day"], "month": parts["month"], "year": parts["year"], "season": dates.season(F.month(date))}
    )


def date_completeness(df: DataFrame, date: str = "review_date") -> DataFrame:
    """Filled count and percentage of each date part, first and last year: one row."""
    rows = with_date_parts(df.select(date), date)
    named = ["day", "month", "year", "season"]
    filled = [F.count(c).alias(f"{c}_filled") for c in named]
    shares = [
        F.when(F.count("*") > 0, F.round(100.0 * F.count(c) / F.count("*"), 6)).alias(f"{c}_pct") for c in named
    ]
    return rows.agg(
        F.count("*").alias("total"), *filled, *shares, F.min("year").alias("min_year"), F.max("year").alias("max_year")
    )


def count_by_year_season(df: DataFrame, date: str = "review_date", text: str = "commentaire") -> DataFrame:
    """Non-null comments per calendar year and season."""
    rows = with_date_parts(df.filter(F.col(date).isNotNull()).select(date, text), date)
    return rows.groupBy("year", "season").agg(F.count(text).alias("n"))


def daily_counts(df: DataFrame, date: str = "review_date") -> DataFrame:
    """Rows per day, undated rows left out."""
    return df.filter(F.col(date).isNotNull()).groupBy(F.to_date(date).alias("day")).agg(F.count("*").alias("n"))


def peak_day(daily: DataFrame) -> DataFrame:
    """The busiest day, the earliest one on a tie."""
    return daily.orderBy(F.desc("n"), "day").limit(1)


def monthly_counts(df: DataFrame, date: str = "review_date", text: str = "commentaire") -> DataFrame:
    """Non-null comments per month."""
    month = F.to_date(F.date_trunc("month", F.col(date).cast("timestamp")))
    return df.filter(F.col(date).isNotNull()).groupBy(month.alias("month")).agg(F.count(text).alias("n"))


def top_months(monthly: DataFrame, n: int = 5) -> DataFrame:
    return monthly.orderBy(F.desc("n"), "month").limit(n)


def daily_outliers(daily: DataFrame, z: float = 3.0) -> DataFrame:
    """Days whose count lies more than ``z`` sample standard deviations above the mean."""
    mean, std = daily.agg(F.avg("n")).scalar(), daily.agg(F.stddev_samp("n")).scalar()
    scored = daily.withColumn("z_score", (F.col("n") - mean) / F.nullif(std, F.lit(0.0)))
    return scored.filter(F.col("z_score") > z).withColumn("z_score", F.round("z_score", 6))


def daily_describe(daily: DataFrame) -> DataFrame:
    return profile.describe_numeric(daily, "n")


def total_of_daily(daily: DataFrame) -> DataFrame:
    return daily.agg(F.sum("n").alias("total"))

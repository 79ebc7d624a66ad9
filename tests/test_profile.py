import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from opinio.operators import profile, timeseries


def test_length_bins_are_right_closed(spark):
    values = [0, 50, 51, 100, 2000, 2001]
    df = spark.createDataFrame([(x,) for x in values], "n int").select("n", profile.length_bin_name(profile.length_bin("n")).alias("b"))
    assert [r["b"] for r in df.orderBy("n").collect()] == ["<50", "<50", "50-100", "50-100", "1000-2000", "2000+"]


def test_empty_bins_stay(spark):
    df = spark.createDataFrame([("x" * 60, "ok"), ("x" * 70, None), (None, None)], "commentaire string, reponse string")
    rates = {r["length_bin"]: r["response_rate"] for r in profile.response_rate_by_length(df).collect()}
    assert len(rates) == 7 and rates["50-100"] == 0.5 and rates["<50"] == 0.0 and rates["2000+"] is None
    counts = {r["length_bin"]: (r["without_response"], r["with_response"]) for r in profile.response_counts_by_length(df).collect()}
    assert counts["50-100"] == (1, 1) and counts["2000+"] == (0, 0)


def test_describe_like_pandas(spark):
    values = [1, 2, 2, 5, 9, 9, 30, None]
    got = profile.describe_numeric(spark.createDataFrame([(x,) for x in values], "n int"), "n").first()
    want = pd.Series(values).describe()
    assert got["count"] == 7
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q1", "25%"), ("median", "50%"), ("q3", "75%"), ("max", "max")):
        assert abs(got[ours] - want[theirs]) < 1e-5


def test_histogram_last_bin_closed(spark):
    values = list(range(0, 101))
    df = profile.length_histogram(spark.createDataFrame([(x,) for x in values], "n int"), "n", 10)
    want = np.histogram(values, bins=10)[0].tolist()
    assert [r["n"] for r in df.orderBy("bin").collect()] == want


def test_histogram_of_one_value(spark):
    df = profile.length_histogram(spark.createDataFrame([(3,), (3,)], "n int"), "n", 5)
    assert sum(r["n"] for r in df.collect()) == 2


def test_daily_outliers(spark):
    rows = [(f"2020-01-{d:02d}", 1) for d in range(1, 29)] + [("2020-01-29", 1)] * 60
    df = spark.createDataFrame(rows, "d string, x int").select(F.to_date("d").alias("review_date"))
    daily = timeseries.daily_counts(df)
    assert [(str(r["day"]), r["n"]) for r in timeseries.daily_outliers(daily).collect()] == [("2020-01-29", 60)]
    assert timeseries.total_of_daily(daily).first()["total"] == 88


def test_all_null_dates(spark):
    df = spark.createDataFrame([(None, "a")], "review_date date, commentaire string")
    row = timeseries.date_completeness(df).first()
    assert row["total"] == 1 and row["day_filled"] == 0 and row["min_year"] is None
    assert timeseries.daily_counts(df).count() == 0
    assert timeseries.daily_outliers(timeseries.daily_counts(df)).count() == 0

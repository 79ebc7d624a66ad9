import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.operators import profile, quantiles

QUARTERS = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "p999": 0.999, "high": 1.0}


def _by_hand(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    return values[low] if low == high or values[low] == values[high] else (high - at) * values[low] + (at - low) * values[high]


def test_bits_sort_like_values(spark):
    values = [-math.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, math.inf, math.nan]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("*", quantiles.ordered_bits("v").alias("k"))
    rows = frame.select("*", quantiles.from_ordered_bits(F.col("k")).alias("back")).orderBy("i").collect()
    keys = [r["k"] for r in rows]
    assert keys == sorted(keys) and keys[4] == keys[5] and len(set(keys)) == len(keys) - 1
    assert all(r["back"] == r["v"] or math.isnan(r["v"]) and math.isnan(r["back"]) for r in rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_like_sorted_values_with_a_hot_group(spark, parts):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(size=4000) * 10.0 ** rng.integers(-200, 200, 4000)]
    rows += [(None, float(x)) for x in rng.integers(-3, 4, 501)] + [("one", 7.25), ("two", 1.0), ("two", -1.0)]
    rows += [("same", 2.5)] * 300 + [("none", None), ("hot", None)]
    frame = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit("x")).repartition(parts)
    got = {r["g"]: r for r in quantiles.exact_quantiles(frame, "v", QUARTERS, ["g"]).collect()}
    assert set(got) == {"hot", None, "one", "two", "same"}
    for g, r in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        assert r["n"] == len(values)
        for name, p in QUARTERS.items():
            assert r[name] == _by_hand(values, p), (g, name)


def test_without_groups_and_empty(spark):
    frame = spark.range(1, 100_001).select((F.col("id") * 37 % 100_003).alias("v"))
    r = quantiles.exact_quantiles(frame, "v", QUARTERS).first()
    w = frame.agg(*[F.percentile("v", p).alias(n) for n, p in QUARTERS.items()]).first()
    assert r["n"] == 100_000 and all(r[n] == w[n] for n in QUARTERS)
    nothing = quantiles.exact_quantiles(frame.limit(0), "v", QUARTERS).collect()
    assert [(r["n"], r["median"]) for r in nothing] == [(0, None)]
    assert quantiles.exact_quantiles(frame.limit(0).withColumn("g", F.lit(1)), "v", QUARTERS, ["g"]).count() == 0
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(frame, "v", {"x": 1.5})


def test_whiskers_and_outliers(spark):
    frame = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 5, 100, -90]] + [(None, 3.0), ("b", None)], "g string, v double")
    got = {r["g"]: r.asDict() for r in profile.box_stats(frame, "v", ["g"]).collect()}
    assert got["a"] == {"g": "a", "q1": 1.5, "median": 3.0, "q3": 4.5, "whisker_low": 1.0, "whisker_high": 5.0, "outliers": 2}
    assert got[None]["outliers"] == 0 and got[None]["whisker_low"] == 3.0 and set(got) == {"a", None}

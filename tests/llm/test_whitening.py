"""Whitening against numpy on the same fixed-point rows, and the cases that the docstring defines."""

import numpy as np
import pytest

from opinio.llm import whitening as w


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, index string, key string, x string, rid bigint")


def named(rows):
    return [(i, v, "a", "b", "c", 1) for i, v in rows]


def plain(x):
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    return values, (x - x.mean(axis=0)) @ vectors / np.sqrt(values)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    return rng.normal(size=(2500, 9)) @ rng.normal(size=(9, 9)) * 3 + 40


@pytest.fixture(scope="module")
def fitted(spark, sample):
    rows = named((i // 2, v.tolist()) for i, v in enumerate(sample))
    odd = named([(1, None), (2, []), (3, [1.0] * 8 + [None]), (4, [float("nan")] * 9), (5, [float("inf")] * 9), (6, [1.0, 2.0]), (7, [1e300] * 9)])
    return w.whiten(frame(spark, rows + odd).repartition(5), components=6)


def test_equals_numpy(sample, fitted):
    x = np.floor(64 * sample) + 1e6
    values, whitened = plain(x)
    rows = fitted.rows.select("index", "key", "x", "whitened", fitted.deviation().alias("deviation")).toPandas()
    assert len(rows) == fitted.n == len(x) and rows["index"].is_unique
    assert np.allclose(fitted.eigenvalues, values[:6], rtol=1e-10)
    assert np.allclose(fitted.explained, values[:6] / values.sum(), rtol=1e-10)
    place = {tuple(r): i for i, r in enumerate(x.astype(int))}
    at = [place[tuple(r)] for r in rows["x"]]
    assert sorted(at) == list(range(len(x)))
    assert np.allclose(np.abs(np.stack(rows["whitened"])), np.abs(whitened[at, :6]), atol=1e-8)
    exact = [sum((len(x) * int(a) - s) ** 2 for a, s in zip(r, fitted.sums)) for r in rows["x"]]
    assert rows["deviation"].tolist() == exact
    assert fitted.identity_error < 1e-9


def test_blocks_of_any_size_give_the_same_scatter(spark, sample):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(sample[:300])], "index bigint, v array<double>")
    for rows in (7, 300, 1024):
        assert np.allclose(w.scatter(w.to_blocks(table, table["v"], 300, 9, rows)), sample[:300].T @ sample[:300])


def test_nothing_to_fit(spark):
    assert w.whiten(frame(spark, [])) is None
    assert w.whiten(frame(spark, named([(1, None), (2, [])]))) is None


def test_components_without_variance_are_null(spark):
    rows = named((i, [float(i), 5.0, 7.0]) for i in range(20))
    fit = w.whiten(frame(spark, rows))
    found = [r["whitened"] for r in fit.rows.collect()]
    assert all(r[0] is not None and r[1] is None and r[2] is None for r in found)
    assert fit.identity_error < 1e-9 and fit.explained.tolist() == pytest.approx([1, 0, 0])
    same = w.whiten(frame(spark, named((i, [1.0, 2.0]) for i in range(4))))
    assert same.n == 4 and same.identity_error is None and {tuple(r["whitened"]) for r in same.rows.collect()} == {(None, None)}


def test_large_entries_have_no_long_deviation(spark):
    rows = named((i, [float(i) * 1e12, 0.5]) for i in range(9))
    fit = w.whiten(frame(spark, rows))
    assert {r[0] for r in fit.rows.select(fit.deviation()).collect()} >= {None}


def test_query_is_whole(spark):
    from opinio.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op13_block_whitening"](spark, sf).toPandas()
    known = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    assert rows.groupby("vec_id").size().to_dict() == dict.fromkeys(known["vec_id"], 32)
    assert rows["identity_error"].max() < 1e-4

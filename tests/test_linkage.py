import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.operators import linkage

SCHEMA = "id long, topics int, embedding array<double>"


def _plain(means, sizes, stop):
    """One merge at a time, from the similarities of all pairs of the first clusters."""
    n = np.array(sizes, dtype=float)
    total = (means @ means.T) * n[:, None] * n[None, :]
    alive, merges = np.ones(len(n), dtype=bool), []
    while alive.sum() > 1:
        likeness = np.where(np.triu(np.outer(alive, alive), 1), total / np.outer(n, n), -np.inf)
        a, b = (int(i) for i in np.unravel_index(likeness.argmax(), likeness.shape))
        if likeness[a, b] < stop:
            break
        total[a] += total[b]
        total[:, a] += total[:, b]
        n[a] += n[b]
        alive[b] = False
        merges.append((a, b, likeness[a, b], int(n[a])))
    return merges


@pytest.mark.parametrize("block, stop", [(1024, -1.0), (64, 0.2)])
def test_like_plain_average_linkage_of_300_centres(spark, monkeypatch, block, stop):
    monkeypatch.setattr(linkage, "BLOCK", block)
    rng = np.random.default_rng(block)
    means = rng.normal(size=(300, 12)) + rng.normal(size=(6, 12))[rng.integers(0, 6, 300)]
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    sizes = rng.integers(1, 9, 300).tolist()
    frame = spark.createDataFrame([(i, n, m.tolist()) for i, (n, m) in enumerate(zip(sizes, means))], "id long, n long, m array<double>")
    got = linkage.merge_table(frame, stop).orderBy(F.desc("similarity")).collect()
    want = _plain(means, sizes, stop)
    assert [(r["a"], r["b"], r["n"]) for r in got] == [(a, b, n) for a, b, _, n in want]
    assert np.allclose([r["similarity"] for r in got], [s for _, _, s, _ in want], atol=1e-9)


def test_topics_merge_by_the_mean_cosine_of_their_pairs(spark):
    rows = [(1, 4, [2.0, 0.0]), (2, 4, [1.0, 1.0]), (3, 7, [3.0, 0.1]), (4, 9, [0.0, -1.0]), (5, -1, [1.0, 0.0]), (6, None, [1.0, 0.0])]
    rows += [(7, 11, None), (8, 9, [None, 1.0]), (9, 4, [float("nan"), 1.0]), (10, 7, [3.0, 0.1])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x"))
    means = {r["id"]: (r["n"], np.array(r["m"])) for r in linkage.topic_means(frame).collect()}
    assert {k: n for k, (n, _) in means.items()} == {4: 2, 7: 2, 9: 1}
    out = linkage.merge_similar_topics(frame, 0.8)
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" int", "").replace(" array<double>", "").split(", "), "n"]
    assert {r["id"]: r["topics"] for r in out.collect()} == {1: 4, 2: 4, 3: 4, 4: 9, 5: -1, 6: None, 7: 11, 8: 9, 9: 4, 10: 4}
    assert linkage.merge_similar_topics(frame.limit(0), 0.5).count() == 0


def test_equal_similarities_all_merge(spark):
    frame = spark.createDataFrame([(i, 1, [1.0, 0.0]) for i in range(9)], "id long, n long, m array<double>")
    got = linkage.merge_table(frame).collect()
    assert len(got) == 8 and max(r["n"] for r in got) == 9


def test_the_registered_query_merges_like_plain_linkage(spark):
    import pandas as pd

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got = entry.queries()["topic_merges"](spark, folder).orderBy(F.desc("similarity")).collect()
    rows = pd.read_parquet(f"{folder}/embeddings.parquet").dropna(subset=["label", "embedding"])
    unit = np.array([np.array(e, dtype=float) / np.linalg.norm(e) for e in rows["embedding"]])
    names = sorted(rows["label"].unique())
    means = np.array([unit[(rows["label"] == t).to_numpy()].mean(axis=0) for t in names])
    want = _plain(means, [int((rows["label"] == t).sum()) for t in names], -2.0)
    assert [(r["a"], r["b"], r["n"]) for r in got] == [(names[a], names[b], n) for a, b, _, n in want]
    assert np.allclose([r["similarity"] for r in got], [m[2] for m in want], atol=1e-8)

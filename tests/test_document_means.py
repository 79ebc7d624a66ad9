"""Mean vectors of documents against numpy, whatever the blocks; vectors move to blocks, not to documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.operators import vectors


@pytest.mark.parametrize("cells", [1, 60, 8_000_000])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_means_whatever_the_blocks(spark, monkeypatch, cells, kind):
    monkeypatch.setattr(vectors, "BLOCK_CELLS", cells)
    monkeypatch.setattr(vectors, "CELLS", 7)
    draw = random.Random(2)
    docs = [(i, [f"w{draw.randrange(30)}" for _ in range(draw.randrange(0, 12))]) for i in range(60)]
    docs += [(3, ["w1", "w1", None]), (None, ["w1"]), (70, None), (71, []), (72, ["unknown"])]
    known = [(f"w{i}", [draw.random() for _ in range(3)]) for i in range(20)] + [("w1", [5.0, 1.0, 0.0]), ("w2", [None, 1.0, 2.0])]
    df = spark.createDataFrame(docs, "k long, t array<string>").repartition(3)
    got = vectors.doc_vector_mean(df, spark.createDataFrame(known, f"term string, vector array<{kind}>"), F.col("t"), "k", 3).collect()
    words = {}
    for k, t in docs:
        if k is not None:
            words.setdefault(k, []).extend(t or [])
    for k in {k for k, _ in docs}:
        found = [[x or 0.0 for x in v] for w in words.get(k, []) for name, v in known if name == w]
        mean = np.mean(found, axis=0) if found else np.zeros(3)
        for row in (r for r in got if r["k"] == k):
            assert np.allclose(row["embedding"], mean / (np.linalg.norm(mean) or 1.0), atol=1e-6)
    assert sorted(str(r["k"]) for r in got) == sorted(str(k) for k, _ in docs)


def test_a_vector_moves_once_to_a_block(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").alias("comment_id"), F.array(*[F.lit(f"w{i}") for i in range(50)]).alias("t")).repartition(4)
    known = spark.createDataFrame([(f"w{i}", [1.0, float(i)]) for i in range(50)], "term string, vector array<double>")
    told = []
    plain = vectors._block_sums
    monkeypatch.setattr(vectors, "_block_sums", lambda d: told.append(d) or plain(d))
    rows = []
    keep = vectors.store
    monkeypatch.setattr(vectors, "store", lambda table, name: rows.append(keep(table, name)) or rows[-1])
    assert vectors.doc_vector_mean(df, known, F.col("t")).count() == 400
    assert told == [2] and rows[0].agg(F.sum(F.size("names"))).first()[0] <= 4 * 50  # not 400 * 50

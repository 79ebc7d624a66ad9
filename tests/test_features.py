import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.functions import vectors as vx
from opinio.operators import features, vectors
from opinio.operators.features import TfidfParams

DOCS = {1: "le colis est le bon", 2: "colis cassé", 3: "le sav", 4: ""}


def _expected(docs):
    tokens = {i: [t for t in d.split() if len(t) > 1] for i, d in docs.items()}
    df = Counter(t for ts in tokens.values() for t in set(ts))
    out = {}
    for i, ts in tokens.items():
        raw = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in Counter(ts).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.update({(i, t): x / norm for t, x in raw.items()})
    return out


def _docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "comment_id long, c string").withColumn("t", F.split("c", " "))


def test_tfidf_formula(spark):
    tokens = F.filter("t", lambda x: F.length(x) > 1)
    want = _expected(DOCS)
    for params in (TfidfParams(), TfidfParams(max_features=1000)):
        got = {(r["comment_id"], r["term"]): r["w"] for r in features.tfidf(_docs(spark), "comment_id", tokens, params).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_document_frequency_limits_are_inclusive(spark):
    vocab, _ = features.tfidf_fit(_docs(spark), "comment_id", F.filter("t", lambda x: x != ""), TfidfParams(min_df=2, max_df=0.5))
    assert sorted(r["term"] for r in vocab.collect()) == ["colis", "le"]


def test_unit_length_and_zero(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "i int, v array<double>")
    got = [r[0] for r in df.orderBy("i").select(vx.l2_normalize("v")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_doc_vector_mean(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "term string, vector array<double>")
    docs = spark.createDataFrame([(1, ["a", "a", "b", "zz"]), (2, ["zz"]), (3, [])], "comment_id long, t array<string>")
    got = {r["comment_id"]: r["embedding"] for r in vectors.doc_vector_mean(docs, vecs, F.col("t")).collect()}
    assert got[1] == pytest.approx([2 / math.sqrt(8), 2 / math.sqrt(8)]) and got[2] == [0.0, 0.0] == got[3]


def test_embed_texts_covers_every_row_with_unit_vectors(spark):
    df = spark.createDataFrame([(i, f"texte numéro {i}" if i % 7 else None) for i in range(50)], "comment_id long, clean_comment string")
    rows = vectors.embed_texts(df, lambda: vectors.hashing_encoder(16), batch_size=8).collect()
    assert sorted(r["comment_id"] for r in rows) == list(range(50))
    norms = [float(np.linalg.norm(r["embedding"])) for r in rows]
    assert all(abs(n - 1) < 1e-5 or n == 0 for n in norms) and any(n == 0 for n in norms)


def _commonest(lists, low, high, k):
    grams = Counter(" ".join(t[i : i + n]) for t in lists for n in range(low, high + 1) for i in range(len(t) - n + 1))
    return sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_top_ngrams_are_exact_and_count_few(spark, monkeypatch):
    import random

    from opinio.session import store

    draw = random.Random(5)
    lists = [[f"w{int(draw.paretovariate(0.7)) % 300}" for _ in range(draw.randrange(0, 40))] for _ in range(120)] + [["w1"] * 9, [], None]
    df = store(spark.createDataFrame([(t,) for t in lists], "t array<string>"), "test-tokens")
    known = [t for t in lists if t]
    for first in (1, 5, 2000):
        for listed in (3, 20_000):
            monkeypatch.setattr(features, "FIRST_WORDS", first)
            monkeypatch.setattr(features, "LISTED", listed)
            for low, high, k in ((1, 1, 4), (2, 3, 20), (3, 3, 15), (2, 2, 100_000)):
                got = [(r["term"], r["n"]) for r in features.top_ngrams(df, "t", low, high, k).collect()]
                assert sorted(got, key=lambda x: (-x[1], x[0])) == _commonest(known, low, high, k)


def test_limited_vocabulary_makes_rows_of_its_terms_only(spark, monkeypatch):
    rows = [(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, ["d", "b", "a"]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    params = features.TfidfParams(1, 2, max_features=2)
    seen = []
    plain = features.vocabulary
    monkeypatch.setattr(features, "vocabulary", lambda counts, *a: seen.append({r["term"] for r in counts.collect()}) or plain(counts, *a))
    vocab, weights = features.tfidf_fit(df, "id", F.col("t"), params)
    assert {r["term"]: (r["df"], r["cf"]) for r in vocab.collect()} == {"a": (3, 4), "b": (2, 2)}
    assert {r["id"] for r in weights.collect()} == {1, 2, 3} and seen == [{"a", "b"}]

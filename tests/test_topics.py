import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.operators import density, quality, topics

WORDS = ["a", "b", "c", "d", "e", "zz"]


def _random_docs(seed, n, longest):
    rng = np.random.default_rng(seed)
    vocab = ["a", "b", "c", "d", "e"] + [f"x{i}" for i in range(12)]
    return [[vocab[j] for j in rng.integers(0, len(vocab), rng.integers(0, longest))] for _ in range(n)]


def _naive_cv(topic_lists, docs, window):
    relevant = {w for ws in topic_lists for w in ws}
    windows = []
    for doc in docs:
        if relevant & set(doc):
            windows += [set(doc[s : s + window]) for s in range(max(len(doc) - window, 0) + 1)]
    total, seen = len(windows), {w for d in docs for w in d}
    p = lambda *ws: sum(all(w in win for w in ws) for win in windows) / total
    scores = []
    for ws in topic_lists:
        ws = [w for w in ws if w in seen]
        m = np.array([[math.log((p(a, b) + 1e-12) / (p(a) * p(b))) / -math.log(p(a, b) + 1e-12) for b in ws] for a in ws])
        star = m.sum(0)
        scores.append(np.mean([r @ star / (np.linalg.norm(r) * np.linalg.norm(star)) for r in m]))
    return scores


def _frames(spark, topic_lists, docs):
    tw = [(t, i + 1, w) for t, ws in enumerate(topic_lists) for i, w in enumerate(ws)] + [(-1, 1, "noise")]
    return (
        spark.createDataFrame(tw, "topic int, rank int, word string"),
        spark.createDataFrame([(d,) for d in docs], "t array<string>"),
    )


@pytest.mark.parametrize("window", [3, 7, 110])
def test_cv_like_naive_windows(spark, window):
    lists, docs = [["a", "b", "c"], ["c", "d", "e", "zz"]], _random_docs(window, 60, 30)
    tw, frame = _frames(spark, lists, docs)
    overall = quality.coherence_cv(tw, frame, F.col("t"), window=window).first()["score"]
    assert overall == pytest.approx(np.mean(_naive_cv(lists, docs, window)), abs=2e-6)
    alone = {r["topic"]: r["score"] for r in quality.coherence_cv(tw, frame, F.col("t"), window=window, per_topic=True).collect()}
    assert alone == {t: pytest.approx(_naive_cv([ws], docs, window)[0], abs=2e-6) for t, ws in enumerate(lists)}


def test_umass_like_naive(spark):
    lists, docs = [["a", "b", "c"], ["c", "d", "e", "zz"]], _random_docs(1, 80, 20)
    tw, frame = _frames(spark, lists, docs)
    sets = [set(d) for d in docs]
    count = lambda *ws: sum(all(w in s for w in ws) for s in sets)
    want = []
    for ws in lists:
        ws = [w for w in ws if count(w)]
        want.append(np.mean([math.log((count(ws[i], ws[j]) / 80 + 1e-12) / (count(ws[j]) / 80)) for i in range(len(ws)) for j in range(i)]))
    got = {r["topic"]: r["score"] for r in quality.coherence_umass(tw, frame, F.col("t"), per_topic=True).collect()}
    assert got == {0: pytest.approx(want[0], abs=2e-6), 1: pytest.approx(want[1], abs=2e-6)}


def test_embedding_coherence_equals_pair_mean(spark):
    rng = np.random.default_rng(3)
    vecs = {w: rng.normal(size=4) for w in "abcd"}
    tw, _ = _frames(spark, [["a", "b", "c"], ["d"], ["a", "d"]], [["a"]])
    frame = spark.createDataFrame([(w, v.tolist()) for w, v in vecs.items()], "term string, vector array<double>")
    cos = lambda x, y: vecs[x] @ vecs[y] / np.linalg.norm(vecs[x]) / np.linalg.norm(vecs[y])
    want = np.mean([np.mean([cos(x, y) for x, y in itertools.permutations(ws, 2)]) for ws in ("abc", "ad")])
    assert quality.coherence_embedding(tw, frame).first()["score"] == pytest.approx(want, abs=2e-6)


def test_diversity_leaves_noise_out(spark):
    tw, _ = _frames(spark, [["a", "b"], ["b", "c"]], [["a"]])
    assert quality.topic_diversity(tw).first()["diversity"] == 0.75


def test_dominant_topic_takes_the_first_maximum(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "topic_dist array<double>")
    assert topics.dominant_topic(df).first()[1:] == (1, 0.4)


def _naive_density(points, eps, core_at, min_size):
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    near = d <= eps
    core = near.sum(1) >= core_at
    label = np.full(len(points), -1)
    for i in range(len(points)):
        if core[i] and label[i] == -1:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] == -1:
                    label[j] = i
                    stack += [k for k in np.nonzero(near[j] & core)[0] if label[k] == -1]
    for i in range(len(points)):
        if not core[i] and (near[i] & core).any():
            label[i] = label[np.nonzero(near[i] & core)[0].min()]
    sizes = {c: (label == c).sum() for c in set(label)}
    return [int(c) if c >= 0 and sizes[c] >= min_size else -1 for c in label]


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_density_like_brute_force_with_a_third_copies(spark, block_rows):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.3, size=(25, 3)) for c in (0, 2, 9)] + [np.full((40, 3), 4.0), rng.uniform(-8, 8, (10, 3))])
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    got = density.density_clusters(frame, "id", "v", 0.6, 4, 8, block_rows=block_rows)
    assert [r["cluster"] for r in got.orderBy("id").collect()] == _naive_density(points, 0.6, 4, 8)


def test_density_blocks_let_each_near_pair_meet_once_in_several_tasks(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(60, 3))
    frame = spark.createDataFrame([(i, p.tolist(), 1, False) for i, p in enumerate(points)], "id long, v array<double>, w long, core boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = density._blocks(frame, [points[0]], 1.5, 5).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    groups, tasks = {}, {}
    for r in placed:
        key = (tuple(r["cell"]), r["own"], r["hb"], r["vb"])
        groups.setdefault(key, ([], []))[0 if r["home"] else 1].append(r["id"])
        tasks.setdefault(key[0], set()).add(r["task"])
    met = []
    for (_, own, hb, vb), (home, guest) in groups.items():
        met += [(a, b) for a in home for b in home if a < b] if own and hb == vb else [(min(a, b), max(a, b)) for a in home for b in guest]
    near = {(a, b) for a in range(60) for b in range(a + 1, 60) if np.linalg.norm(points[a] - points[b]) <= 1.5}
    assert len(met) == len(set(met)) and near <= set(met)
    assert max(len(t) for t in tasks.values()) > 1


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60).select("id")
    edges = spark.range(58).filter("id <> 30").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["id"]: r["component"] for r in density.connected_components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 30 else (31 if i <= 58 else 59) for i in range(60)}


def test_similarity_of_each_pair_once(spark):
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "topic int, vector array<double>")
    got = {(r["topic_a"], r["topic_b"]): r["cosine"] for r in topics.topic_similarity(centres.repartition(3)).collect()}
    assert got == {(0, 1): 0.995037, (0, 2): 0.0, (1, 2): 0.099504}


def test_nearest_words_do_not_depend_on_partitions(spark):
    centres = spark.createDataFrame([(0, [1.0, 0.0])], "topic int, vector array<double>")
    words = spark.createDataFrame([("z", [1.0, 0.0]), ("a", [1.0, 1e-8]), ("m", [0.5, 0.5])], "term string, vector array<double>")
    for n in (1, 3):
        assert [r["term"] for r in topics.topic_nearest_words(words.repartition(n), centres, 1).collect()] == ["a"]


def test_zero_and_null_vectors_are_set_aside(spark):
    rows = [(i, [float(i % 2), float(1 - i % 2)]) for i in range(20)] + [(20, [0.0, 0.0]), (21, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    for bisecting in (False, True):
        got = {r["id"]: r["topics"] for r in topics.cluster_embeddings(df, [2], bisecting=bisecting).collect()}
        assert got[20] == got[21] == -1 and len(got) == 22 and {got[i] for i in range(20)} == {0, 1}


def test_vectoriser_keeps_every_term_and_forms_ngrams(spark):
    rows = [(i, [f"w{i}_{j}" for j in range(50)] + ["the", "end"]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    assert len(topics.vocabulary_of(topics.tfidf_model(df, "tokens"))) == 2002
    grams = topics.tfidf_model(df, "tokens", min_df=2, low=1, high=2, stops=["the"])
    assert topics.vocabulary_of(grams) == ["end"]
    both = topics.tfidf_model(df, "tokens", min_df=2, low=1, high=2)
    assert sorted(topics.vocabulary_of(both)) == ["end", "the", "the end"]
    assert both.transform(df).select("features").first()[0].numNonzeros() == 3


def test_coherence_reads_texts_once_and_in_slices(spark, monkeypatch):
    import random

    draw = random.Random(3)
    vocab = [f"m{i}" for i in range(12)]
    docs = [[draw.choice([*vocab, "x", "y", "z", None]) for _ in range(draw.choice([0, 3, 40, 300]))] for _ in range(60)] + [None, []]
    lists = [(0, r + 1, w) for r, w in enumerate(vocab[:5])] + [(1, r + 1, w) for r, w in enumerate(vocab[3:9])] + [(1, 9, "m3"), (2, 1, "nowhere")]
    both, total = {}, {}
    for t in docs:
        last = max(len(t or []) - 20, 0)
        views = [set((t or [])[s : s + 20]) for s in range(last + 1)]
        for k in (0, 1, 2, None):
            words = {w for x, _, w in lists if k in (x, None)}
            if words & set(t or []):
                total[k] = total.get(k, 0) + last + 1
            for v in views if k is not None else []:
                for a in words & v:
                    for b in words & v:
                        if a <= b:
                            both[k, a, b] = both.get((k, a, b), 0) + 1
    frame = spark.createDataFrame([(t,) for t in docs], "t array<string>")
    for tokens in (1, 50, 1 << 18):
        monkeypatch.setattr(quality, "SLICE_TOKENS", tokens)
        got = frame.mapInArrow(quality._count_windows(lists, 20), "topic int, a string, b string, n bigint").collect()
        seen = {}
        for r in got:
            seen[r["topic"], r["a"], r["b"]] = seen.get((r["topic"], r["a"], r["b"]), 0) + r["n"]
        assert {k: n for k, n in seen.items() if k[1]} == both
        assert {k[0]: n for k, n in seen.items() if not k[1] and n} == total

    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def once(t):
        read.add(1)
        return t

    tw = spark.createDataFrame(lists, "topic int, rank int, word string")
    quality.coherence_cv(tw, frame.withColumn("t", once("t")), F.col("t"), per_topic=True).collect()
    assert read.value == len(docs)


def test_embedding_coherence_looks_up_topic_words_only(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(term):
        read.add(1)
        return [float(len(term)), 1.0]

    vecs = spark.createDataFrame([("a" * i,) for i in range(1, 30)], "term string").select("term", vector("term").alias("vector"))
    tw = spark.createDataFrame([(0, 1, "a"), (0, 2, "aa"), (0, 3, "aaa"), (-1, 1, "aaaa")], "topic int, rank int, word string")
    units = [np.array([i, 1.0]) / np.hypot(i, 1) for i in (1, 2, 3)]
    want = np.mean([x @ y for i, x in enumerate(units) for j, y in enumerate(units) if i != j])
    assert quality.coherence_embedding(tw, vecs).first()["score"] == pytest.approx(want, abs=2e-6)
    assert read.value == 3


def test_ctfidf_looks_at_terms_once(spark):
    texts = [(0, ["a", "b", "a"]), (1, ["a", "c"]), (1, ["c", "c"]), (2, ["a", "d", None]), (None, ["c", "a"]), (2, None)]
    df = spark.createDataFrame(texts, "topics int, t array<string>")
    got = topics.ctfidf(df, "t", low=1, high=1, max_df=0.75)
    # "a" is in four of four classes and left out; the class without a name counts for f but has no rows of its own.
    tf, f = {(0, "b"): 1, (1, "c"): 3, (2, "d"): 1}, {"b": 1, "c": 4, "d": 1}
    sizes = {0: 1, 1: 3, 2: 1, None: 1}
    mean = sum(sizes.values()) // len(sizes)
    want = {k: n / sizes[k[0]] * math.log(1 + mean / f[k[1]]) for k, n in tf.items()}
    assert {(r["topic"], r["term"]): pytest.approx(r["weight"]) for r in got.collect()} == want
    # Only the sizes are joined to the stored terms: neither totals nor class numbers are looked up again.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1

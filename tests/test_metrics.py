from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.operators import knn, labels, metrics, relational, splits


def _scores(spark, rows):
    return spark.createDataFrame(rows, "id long, label string, y_true int, score double")


def test_threshold_border(spark):
    df = _scores(spark, [(1, "a", 1, 0.5), (2, "a", 0, 0.4)])
    assert [r["prediction"] for r in metrics.apply_thresholds(df, {"a": 0.5}).orderBy("id").collect()] == [0, 0]
    assert [r["prediction"] for r in metrics.apply_thresholds(df, {"a": 0.5}, strict=False).orderBy("id").collect()] == [1, 0]


def test_best_threshold_like_a_sweep(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), np.round(rng.uniform(0, 1, 300), 2)
    best, best_t = 0.0, 0.5
    for t in range(10, 91):
        p = np.round(s * 100) > t
        f1 = 2 * (p & (y == 1)).sum() / max(p.sum() + y.sum(), 1)
        if f1 > best:
            best, best_t = f1, t / 100
    rows = [(i, "a", int(y[i]), float(s[i])) for i in range(300)] + [(i, "b", 0, 0.3) for i in range(5)]
    got = {r["label"]: (r["threshold"], r["f1"]) for r in metrics.best_threshold(_scores(spark, rows)).collect()}
    assert got["a"] == (best_t, pytest.approx(best, abs=1e-6)) and got["b"] == (0.5, 0.0)


def test_label_never_predicted_gives_zeros(spark):
    df = _scores(spark, [(1, "a", 1, 0.9), (1, "b", 1, 0.1), (2, "a", 0, 0.1), (2, "b", 0, 0.1)])
    preds = df.withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    report = {r["name"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in metrics.per_label_report(preds).collect()}
    assert report["b"] == (0.0, 0.0, 0.0, 1)
    assert report["micro avg"] == (1.0, 0.5, 0.666667, 2)
    assert report["samples avg"] == (0.5, 0.25, 0.333333, 2)
    counts = {r["label"]: (r["tn"], r["fp"], r["fn"], r["tp"]) for r in metrics.confusion_per_label(preds).collect()}
    assert counts == {"a": (1, 0, 0, 1), "b": (1, 0, 1, 0)}
    assert metrics.hamming_loss(preds).first()[0] == 0.25


def test_splits_are_stable_and_cover(spark):
    ids = spark.range(2000)
    a = {r["id"]: r["split"] for r in splits.train_val_test_split(ids, "id").collect()}
    b = {r["id"]: r["split"] for r in splits.train_val_test_split(ids.repartition(7), "id").collect()}
    sizes = Counter(a.values())
    assert a == b and abs(sizes["test"] - 400) < 80 and abs(sizes["val"] - 240) < 60
    assert {r["fold"] for r in splits.kfold(ids, "id").collect()} == {0, 1, 2, 3, 4}


def test_labels_by_review_takes_first_non_null_and_max(spark):
    rows = [(1, 1, "x", 0), (1, 0, None, 1), (1, 2, "y", 0), (2, 0, "z", 0)]
    df = spark.createDataFrame(rows, "comment_id long, sent_no int, c string, l int")
    got = {r["comment_id"]: (r["c"], r["l"]) for r in labels.labels_by_review(df, ["c"], ["l"]).collect()}
    assert got == {1: ("x", 1), 2: ("z", 0)}


def test_normalize_category(spark):
    df = spark.createDataFrame([(" Service Client ",), ("Mixte",), (None,)], "`Catégorie` string")
    assert [r[0] for r in labels.normalize_category(df).collect()] == ["service client", "mixte", None]


def _brute(train, test, k, fold=None):
    from collections import defaultdict
    import math

    n = len(train)
    df = Counter(t for d in train.values() for t in set(d))
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}

    def vec(d):
        raw = {t: c * idf[t] for t, c in Counter(d).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return defaultdict(float, {t: x / norm for t, x in raw.items()})

    tv = {i: vec(d) for i, d in train.items()}
    out = {}
    for q, d in test.items():
        v = vec(d)
        sims = [(-round(sum(x * tv[i][t] for t, x in v.items()), 9) + 0.0, i) for i in train if fold is None or fold[i] != fold[q]]
        out[q] = [(i, -s) for s, i in sorted(sims)[:k]]
    return out


def _texts(seed, n):
    rng = np.random.default_rng(seed)
    hot, rare = ["the", "of", "and"], [f"w{i}" for i in range(40)]
    texts = [["the"] * int(rng.integers(0, 4)) + [str(x) for x in rng.choice(hot + rare, rng.integers(0, 8))] for _ in range(n)]
    for i in range(0, n, 3):
        texts[i] = ["copied", "text", "the"]
    return texts


@pytest.mark.parametrize("k, hot", [(3, 100_000), (10, 5)])
def test_knn_like_brute_force_with_copies(spark, monkeypatch, k, hot):
    monkeypatch.setattr(knn, "HOT_ROWS", hot)
    texts = _texts(k, 90)
    train, test = {i: texts[i] for i in range(60)}, {i: texts[i] for i in range(60, 90)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "comment_id long, tokens array<string>")
    got = {}
    for r in knn.nearest_neighbours(frame(train), frame(test), k, "comment_id", "tokens").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["sim"]))
    want = _brute(train, test, k)
    for q in test:
        assert sorted(got[q], key=lambda e: (-e[1], e[0])) == [(i, pytest.approx(s, abs=2e-9)) for i, s in want[q]], q


def test_knn_other_folds_only(spark):
    texts = dict(enumerate(_texts(7, 60)))
    fold = {i: i % 4 for i in texts}
    rows = spark.createDataFrame([(i, t, fold[i]) for i, t in texts.items()], "comment_id long, tokens array<string>, fold int")
    got = {}
    for r in knn.nearest_neighbours(rows, rows, 5, "comment_id", "tokens", "fold").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["sim"]))
    want = _brute(texts, texts, 5, fold)
    for q in texts:
        assert sorted(got[q], key=lambda e: (-e[1], e[0])) == [(i, pytest.approx(s, abs=2e-9)) for i, s in want[q]], q


def test_exact_match_votes_alone(spark):
    near = spark.createDataFrame([(1, 10, 1.0), (1, 11, 0.9), (1, 12, 0.9)], "id long, neighbour long, sim double")
    truth = spark.createDataFrame([(10, "a", 0), (11, "a", 1), (12, "a", 1)], "id long, label string, y_true int")
    assert knn._votes(near, truth, True).first()["prediction"] == 0
    assert knn._votes(near, truth, False).first()["prediction"] == 1


def test_labels_by_review_hashes_sentences_before_any_sort(spark):
    rows = [(i, "x" * 50 + str(i), s, int(s == i % 3)) for i in range(20) for s in range(5)]
    df = spark.createDataFrame(rows, "comment_id int, c string, sent_no int, l int")
    out = labels.labels_by_review(df, ["c"], ["l"])
    assert {r["comment_id"]: (r["c"], r["l"]) for r in out.collect()} == {i: ("x" * 50 + str(i), 1) for i in range(20)}
    steps = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate" in line]
    assert "HashAggregate" in steps[-1]


def test_labels_by_review_of_repeated_ids(spark):
    rows = [(1, "late", 4, 0), (1, None, 0, 1), (1, "early", 2, 0), (1, "early", 5, 0), (2, None, 1, 0), (None, "n", 3, 1)]
    df = spark.createDataFrame(rows, "comment_id int, c string, sent_no int, l int")
    got = {r["comment_id"]: (r["c"], r["l"]) for r in labels.labels_by_review(df, ["c"], ["l"]).collect()}
    assert got == {1: ("early", 1), 2: (None, 0), None: ("n", 1)}


def test_small_sheet_is_broadcast_instead_of_the_phrases(spark):
    phrases = spark.range(100).selectExpr("id", "cast(id % 3 as int) as topics", "repeat('x', 20) as commentaire")
    sheet = spark.createDataFrame([(0, "mixte"), (1, None)], "Topic int, `Catégorie` string")
    known = relational.filter_known_categories(relational.join_topic_category(phrases, sheet), ["mixte"])
    assert known.count() == 34
    assert "BroadcastHashJoin" in (plan := known._jdf.queryExecution().sparkPlan().toString()) and "BuildRight" in plan


def test_kept_rows_run_rules_once(spark):
    df = spark.createDataFrame([(1, "la vie"), (2, "rien"), (3, None), (4, "la nuit")], "comment_id int, clean_comment string")
    flags = labels.regex_label(df, {"a": ["la"], "b": ["nuit"]})
    kept = labels.keep_any_label(flags, ["a", "b"])
    assert kept.columns == flags.columns and sorted(r["comment_id"] for r in kept.collect()) == [1, 4]
    none = labels.browse_label(flags, "none", "comment_id", ["a", "b"])
    assert sorted(r["comment_id"] for r in none.collect()) == [2, 3]
    assert [r["comment_id"] for r in labels.browse_label(flags, "b", "comment_id", ["a", "b"]).collect()] == [4]
    for rows in (kept, none):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 2

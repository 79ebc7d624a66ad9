import os

import pytest
from pyspark.sql import functions as F

from opinio.functions import fixed_values as fv, text as tx
from opinio.operators import classify, labels, scoring, topics, vectors
from opinio.sources import feature_store, models, readers, writers
from opinio.streaming import streams


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    header = "Commentaire,star,date,client,reponse,source,company,ville,maj,date_commande,ecart\n"
    (tmp_path / "r.csv").write_text(header + '"ligne 1\nligne ""2"", fin",5,2020-01-01,,,TrustPilot,X,,,,3.0\n', encoding="utf-8")
    row = readers.read_reviews(spark, str(tmp_path / "r.csv")).first()
    assert row["Commentaire"] == 'ligne 1\nligne "2", fin' and row["star"] == 5 and row["client"] is None and row["ecart"] == 3.0


def test_topic_words_file(spark, tmp_path):
    (tmp_path / "w.csv").write_text('Topic,Words\n0,"top, matière"\n1,"abat jour"\n', encoding="utf-8")
    rows = [tuple(r) for r in readers.read_topic_words(spark, str(tmp_path / "w.csv")).orderBy("topic", "rank").collect()]
    assert rows == [(0, 1, "top"), (0, 2, "matière"), (1, 1, "abat jour")]


def test_table_round_trip_and_partition_filter(spark, tmp_path):
    df = spark.createDataFrame([(1, "topic"), (2, "regex")], "comment_id long, provenance string")
    writers.write_table(df, str(tmp_path / "t"), ["provenance"])
    got = readers.read_labelled(spark, str(tmp_path / "t"), "regex")
    assert [r["comment_id"] for r in got.collect()] == [2]
    assert "PartitionFilters: [isnotnull(provenance" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        readers.read_labelled(spark, str(tmp_path / "t"), "other")


def test_feature_store_fills_gaps_and_refuses_orphans(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.createDataFrame([(i, f"texte {i}") for i in range(10)], "comment_id long, c string")
    encode = lambda df: vectors.hashed_vectors(df, tx.analyzer_tokens("c"), dimensions=8)
    assert feature_store.feature_store(rows.limit(4), path, encode).count() == 4
    assert feature_store.feature_store(rows, path, encode).count() == 10
    with pytest.raises(ValueError):
        feature_store.feature_store(rows.filter("comment_id < 5"), path, encode)
    assert feature_store.feature_store(rows.filter("comment_id < 5"), path, encode, force=True).count() == 5


@pytest.fixture(scope="module")
def labelled(spark):
    good, bad = "colis livré vite par la poste", "tissu solide et belle couleur"
    rows = [(i, (good if i % 2 else bad) + f" mot{i % 5}", i % 2, 1 - i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "comment_id long, commentaire string, delivery int, product int")
    return df.withColumn("tokens", tx.analyzer_tokens("commentaire")).cache()


@pytest.fixture(scope="module")
def fitted(labelled):
    vectoriser = topics.tfidf_model(labelled, "tokens", min_df=2)
    models_ = classify.logreg_ovr(vectoriser.transform(labelled), ["delivery", "product"], max_iter=20)
    return classify.MultiLabelModel(vectoriser, models_, {"delivery": 0.21, "product": 0.44})


def test_models_separate_save_and_load(spark, labelled, fitted, tmp_path):
    models.save_model(spark, fitted, str(tmp_path), "logreg", "regex")
    again = models.load_model(spark, str(tmp_path), "logreg", "regex")
    assert again.labels == ["delivery", "product"] and again.thresholds == fitted.thresholds
    for r in scoring.score_batch(labelled, again, "comment_id").collect():
        cell = r["result"]["delivery"]
        assert cell["prediction"] == r["comment_id"] % 2 and 0 <= cell["probability"] <= 1 and cell["threshold"] == 0.21


@pytest.mark.parametrize("fit", [classify.linear_svm_ovr, lambda d, c, **k: classify.gbt_multi(d, c, trees=3, depth=2)])
def test_other_models_score_in_range(labelled, fitted, fit):
    rows = fitted.vectoriser.transform(labelled)
    kw = {"max_iter": 20} if fit is classify.linear_svm_ovr else {}
    scores = classify.classifier_scores(fit(rows, ["delivery", "product"], **kw), rows, "comment_id", ["delivery", "product"]).collect()
    assert len(scores) == 120 and all(0 <= r["score"] <= 1 for r in scores)
    assert all((r["score"] >= 0.5) == bool(r["y_true"]) for r in scores)


def test_grid_search_ranks_parameters(labelled):
    def prepare(train, valid):
        v = topics.tfidf_model(train, "tokens", min_df=2)
        return v.transform(train), v.transform(valid)

    fit = lambda train, names, **p: classify.logreg_ovr(train, names, max_iter=5, **p)
    rows = classify.grid_search(labelled, ["delivery", "product"], fit, {"c": [0.1, 10.0]}, "comment_id", k=2, prepare=prepare).collect()
    assert len(rows) == 2 and rows[0]["f1_macro"] >= rows[1]["f1_macro"]


def test_topic_model_properties(labelled):
    vectoriser = topics.tfidf_model(labelled, "tokens", min_df=2)
    rows = vectoriser.transform(labelled)
    model = topics.lda_fit(rows, k=3, passes=1)
    words = topics.lda_topic_words(model, topics.vocabulary_of(vectoriser), 4)
    assert words.count() == 12 and {r["rank"] for r in words.collect()} == {1, 2, 3, 4}
    dist = topics.dominant_topic(topics.topic_distribution(model, rows, "comment_id")).collect()
    assert len(dist) == 60 and all(abs(sum(r["topic_dist"]) - 1) < 1e-6 and 0 <= r["topic_id"] < 3 for r in dist)


def test_tfidf_model_equals_long_form(labelled):
    from pyspark.ml.functions import vector_to_array

    from opinio.operators import features

    model = topics.tfidf_model(labelled, "tokens")
    vocab = model.stages[0].vocabulary
    dense = {r["comment_id"]: r["x"] for r in model.transform(labelled).select("comment_id", vector_to_array("features").alias("x")).collect()}
    for r in features.tfidf(labelled, "comment_id", F.col("tokens")).collect():
        assert dense[r["comment_id"]][vocab.index(r["term"])] == pytest.approx(r["w"])


def test_streams_equal_batch_and_resume(spark, labelled, fitted, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("inbox", "out", "mark"))
    batch = labelled.select("comment_id", "commentaire")
    batch.filter("comment_id < 30").write.parquet(inbox)

    def run():
        stream = streams.read_reviews_stream(spark, inbox, batch.schema)
        scored = streams.score_stream(stream, fitted, lambda d: d.withColumn("tokens", tx.analyzer_tokens("commentaire")))
        streams.run_available(scored, out, mark)
        return {r["comment_id"]: r["result"]["product"]["prediction"] for r in spark.read.parquet(out).collect()}

    assert len(run()) == 30
    batch.filter("comment_id >= 30").write.mode("append").parquet(inbox)
    want = {r["comment_id"]: r["result"]["product"]["prediction"] for r in scoring.score_batch(labelled, fitted, "comment_id").collect()}
    assert run() == want and spark.read.parquet(out).count() == 60


def test_late_events_are_dropped(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    day = lambda rows: spark.createDataFrame(rows, "s string").select(F.to_timestamp("s").alias("ts"))

    def run():
        stream = streams.read_reviews_stream(spark, inbox, day([("2024-01-01 00:00:00",)]).schema)
        streams.run_available(streams.daily_counts_stream(stream), out, mark)
        return {str(r["day"]): r["n"] for r in spark.read.parquet(out).collect()}

    day([("2024-01-01 01:00:00",), ("2024-01-01 02:00:00",), ("2024-01-05 00:00:00",)]).write.parquet(inbox)
    assert run() == {"2024-01-01": 2}
    day([("2024-01-01 03:00:00",), ("2024-01-09 00:00:00",)]).write.mode("append").parquet(inbox)
    assert run() == {"2024-01-01": 2, "2024-01-05": 1}


GOLD = os.environ.get("OPINIO_GOLD_CSV", "")


@pytest.mark.skipif(not os.path.isfile(GOLD), reason="set OPINIO_GOLD_CSV to the annotated set")
def test_gold_set_facts(spark):
    from opinio.functions import dates

    gold = readers.read_gold(spark, GOLD, fv.LABELS).cache()
    assert gold.count() == 100
    assert {r["label"]: r["n"] for r in labels.label_totals(gold).collect()} == dict(zip(fv.LABELS, [41, 21, 27]))
    assert {r["nb_labels"]: r["n"] for r in labels.label_cardinality(gold).collect()} == {0: 29, 1: 56, 2: 12, 3: 3}
    both = gold.select(
        dates.order_gap_days(dates.normalize_date("date"), dates.normalize_date("date_commande")).alias("gap"), "ecart"
    ).filter("ecart IS NOT NULL")
    assert both.count() == 40 and both.filter("gap <> ecart").count() == 0
    assert gold.filter(tx.clean_general("Commentaire") != F.col("clean_comment")).count() == 0


def test_store_that_cannot_be_read_is_not_replaced(spark, tmp_path):
    import pytest

    from opinio.sources import feature_store

    path = tmp_path / "vectors"
    path.mkdir()
    (path / "part-0.parquet").write_text("no parquet")
    rows = spark.createDataFrame([(1, "a")], "comment_id long, text string")
    with pytest.raises(Exception):
        feature_store.feature_store(rows, str(path), lambda r: r.select("comment_id"))
    assert (path / "part-0.parquet").read_text() == "no parquet"


def test_open_days_are_counted(spark, tmp_path):
    from opinio.streaming import streams

    rows = [(f"2024-01-0{d} 10:00:00",) for d in (1, 1, 2, 3, 3, 3)]
    spark.createDataFrame(rows, "ts string").write.parquet(str(tmp_path / "in"))
    arriving = streams.read_reviews_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    streams.count_days(arriving, str(tmp_path / "out"), str(tmp_path / "mark"))
    assert sorted((str(r["day"]), r["n"]) for r in streams.daily_totals(spark, str(tmp_path / "out")).collect()) == [
        ("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-03", 3)
    ]


def test_cluster_without_shared_folder_is_refused():
    import pytest

    from opinio.session import shared_folder

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_a_task_of_a_fit_has_more_entries_than_its_vector_is_wide(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.sparse(200, {j % 200: 1.0 + i % 3 for j in range(i, i + 4)}), int(i % 5 < 2), int(i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, ["comment_id", "features", "a", "b"]).repartition(8)
    monkeypatch.setattr(classify, "ROWS_PER_TASK", 10)
    used = []
    coalesce = type(df).coalesce
    monkeypatch.setattr(type(df), "coalesce", lambda self, n: used.append(n) or coalesce(self, n))
    wide = classify.logreg_ovr(df, ["a", "b"], tol=1e-9)
    assert used == [1, 1] and list(wide) == ["a", "b"]  # 10 tasks would send 10 vectors of 200 for 400 entries
    monkeypatch.setattr(classify, "WIDTHS_PER_TASK", 0)
    many = classify.logreg_ovr(df, ["a", "b"], tol=1e-9)
    assert used[2:] == [10, 10]
    for label in ("a", "b"):
        assert abs(wide[label].coefficients.toArray() - many[label].coefficients.toArray()).max() < 1e-4

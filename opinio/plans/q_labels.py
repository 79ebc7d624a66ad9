"""Queries over labelling, splits, metrics, k-NN, classifiers and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, text as tx, vectors as vx
from ..operators import classify, features, knn, labels, linear, metrics, relational, scoring, splits, topics, vectors
from ..operators.features import TfidfParams
from ..session import shared_folder, store
from ..sources import feature_store, models, readers, writers
from ..streaming import streams
from . import views as v
from .q_features import tfidf_sql
from .q_profile import CATS, categorised
from .registry import query

W = "WITH " + v.REVIEWS
B, E = rf"(^|[^{v.WORD}])", rf"($|[^{v.WORD}])"


def _rule_sql(patterns, text="clean_comment"):
    """Flag without lookarounds: the product rule's lookahead becomes a removal beforehand."""
    alternation = "|".join(p.replace(r"(?!\s+de\s+(service|livraison|sav))", "").replace(r"\b", "") for p in patterns)
    body = text
    if any("(?!" in p for p in patterns):
        body = rf"regexp_replace({text}, 'qualit(é|e|és|es|ées|ees)?\s+de\s+(service|livraison|sav)', ' ', 'g')"
    return f"CAST(coalesce(regexp_matches({body}, '{B}({alternation}){E}'), false) AS INT)"


CLEAN = f"{W}, cl AS (SELECT *, {v.sql_clean('commentaire')} AS clean_comment FROM reviews)"
RULES = list(v.RULES)
FLAGS = ", ".join(f"{_rule_sql(p)} AS {c}" for c, p in v.RULES.items())
FLAGGED = f"{CLEAN}, fl AS (SELECT comment_id, clean_comment, {FLAGS} FROM cl), nb AS (SELECT *, {' + '.join(RULES)} AS k FROM fl)"


@query("regex_label", f"""{CLEAN} SELECT comment_id, {', '.join(f'{_rule_sql(p)} AS "{c}"' for c, p in fv.LABEL_PATTERNS.items())} FROM cl""")
def _(spark, sf):
    return labels.regex_label(v.clean_reviews(spark, sf)).select("comment_id", *fv.LABELS)


def flagged(spark, sf):
    return labels.regex_label(v.clean_reviews(spark, sf), v.RULES)


@query("regex_label_rules", f"{FLAGGED} SELECT comment_id, {', '.join(RULES)} FROM fl")
def _(spark, sf):
    return flagged(spark, sf).select("comment_id", *RULES)


@query("pack_labels", f"{FLAGGED} SELECT comment_id, array_to_string([{', '.join(RULES)}], ',') AS labels FROM fl")
def _(spark, sf):
    rows = labels.pack_labels(flagged(spark, sf), RULES)
    return rows.select("comment_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query("long_labels", f"{FLAGGED} " + " UNION ALL ".join(f"SELECT comment_id, '{c}' AS label, {c} AS y_true FROM fl" for c in RULES))
def _(spark, sf):
    return labels.long_labels(flagged(spark, sf), "comment_id", RULES)


@query("keep_any_label", f"{FLAGGED} SELECT comment_id FROM nb WHERE k > 0")
def _(spark, sf):
    return labels.keep_any_label(flagged(spark, sf), RULES).select("comment_id")


DEDUPED = f"""{CLEAN}, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commentaire, client ORDER BY comment_id) AS rn FROM cl)
  WHERE rn = 1 AND commentaire IS NOT NULL AND {v.sql_word_count('commentaire')} > 3), fl AS (SELECT {FLAGS} FROM dd)"""


@query(
    "label_totals",
    f"{DEDUPED}, a AS (SELECT count(*) FILTER ({' + '.join(RULES)} > 0) AS m FROM fl) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS label, CAST(sum({c}) AS BIGINT) AS n, round(100::DOUBLE * sum({c}) / max(m), 6) AS pct FROM fl, a" for c in RULES
    ),
)
def _(spark, sf):
    """Raw table to label totals: drop empty texts, first of each (text, client), over three words, clean, label, total."""
    from ..operators import clean

    rows = clean.drop_missing_text(v.reviews(spark, sf).select("comment_id", "commentaire", "client"))
    rows = clean.min_words_filter(clean.dedup_keep_first(rows))
    rows = rows.withColumn("clean_comment", tx.clean_general("commentaire"))
    return labels.label_totals(labels.regex_label(rows, v.RULES), RULES)


@query("label_cardinality", f"{FLAGGED} SELECT k AS nb_labels, count(*) AS n FROM nb GROUP BY 1")
def _(spark, sf):
    return labels.label_cardinality(flagged(spark, sf), RULES)


COVERAGE = "count(*) AS total, count(*) FILTER ({c}) AS labelled, count(*) FILTER (NOT ({c})) AS unlabelled, round(100::DOUBLE * count(*) FILTER ({c}) / count(*), 6) AS rate"


@query("label_coverage", f"{FLAGGED} SELECT {COVERAGE.format(c='k > 0')} FROM nb")
def _(spark, sf):
    return labels.label_coverage(flagged(spark, sf), RULES)


HC = v.sql_hash("CAST(comment_id AS VARCHAR) || ':42'")


@query("browse_label", f"{FLAGGED} SELECT comment_id, clean_comment FROM nb WHERE roman = 1 ORDER BY {HC}, comment_id LIMIT 100")
def _(spark, sf):
    return labels.browse_label(flagged(spark, sf), "roman", "comment_id", RULES).select("comment_id", "clean_comment")


@query("browse_label_none", f"{FLAGGED} SELECT comment_id FROM nb WHERE k = 0 ORDER BY {HC}, comment_id LIMIT 100")
def _(spark, sf):
    return labels.browse_label(flagged(spark, sf), "none", "comment_id", RULES).select("comment_id")


NORMAL = CATS + ", nc AS (SELECT *, lower(trim(cat)) AS c FROM pc)"


def normalised(spark, sf):
    return labels.normalize_category(categorised(spark, sf))


@query("normalize_category", f'{NORMAL} SELECT comment_id, sent_no, c AS "Catégorie" FROM nc')
def _(spark, sf):
    return normalised(spark, sf).select("comment_id", "sent_no", "Catégorie")


HOT = ", ".join(f"CAST(coalesce(c = '{c}', false) AS INT) AS \"{c}\"" for c in fv.LABELS)


@query("one_hot_labels", f"{NORMAL} SELECT comment_id, sent_no, {HOT} FROM nc")
def _(spark, sf):
    return labels.one_hot_labels(normalised(spark, sf)).select("comment_id", "sent_no", *fv.LABELS)


@query(
    "labels_by_review",
    f"""{NORMAL}, h AS (SELECT comment_id, commentaire, star, company, client, {HOT} FROM nc WHERE c IN ({v.lit(fv.LABELS)}))
    SELECT comment_id, any_value(commentaire) AS commentaire, any_value(star) AS star, any_value(company) AS company, any_value(client) AS client,
      {', '.join(f'max("{c}") AS "{c}"' for c in fv.LABELS)} FROM h GROUP BY comment_id""",
)
def _(spark, sf):
    known = relational.filter_known_categories(normalised(spark, sf))
    return labels.labels_by_review(labels.one_hot_labels(known), ["commentaire", "star", "company", "client"])


SETS = f"{NORMAL}, s AS (SELECT comment_id, list(DISTINCT c) FILTER (c IN ({v.lit(fv.LABELS)})) AS l FROM nc GROUP BY comment_id)"


@query("label_set_by_review", f"{SETS} SELECT comment_id, coalesce(array_to_string(list_sort(l), ','), '') AS labels FROM s")
def _(spark, sf):
    sets = labels.label_set_by_review(normalised(spark, sf))
    return sets.withColumn("labels", F.array_join("labels", ","))


@query("label_set_counts", f"{SETS} " + " UNION ALL ".join(f"SELECT '{c}' AS label, count(*) FILTER (coalesce(list_contains(l, '{c}'), false)) AS n FROM s" for c in fv.LABELS))
def _(spark, sf):
    return labels.label_set_counts(labels.label_set_by_review(normalised(spark, sf)))


@query("label_set_coverage", f"{SETS} SELECT {COVERAGE.format(c='coalesce(len(l), 0) > 0')} FROM s")
def _(spark, sf):
    return labels.label_set_coverage(labels.label_set_by_review(normalised(spark, sf)))


@query(
    "group_topics",
    f"""WITH g AS (SELECT CAST(vec_id % 30 AS INT) AS topic_id FROM embeddings)
    SELECT CAST(CASE {' '.join(f"WHEN topic_id IN ({', '.join(map(str, ids))}) THEN {c}" for c, ids in fv.TOPIC_GROUPS.items())} END AS INT) AS label, count(*) AS n FROM g GROUP BY 1""",
)
def _(spark, sf):
    rows = v.embeddings(spark, sf).select((F.col("vec_id") % 30).cast("int").alias("topic_id"))
    return labels.group_topic_counts(labels.group_topics(rows))


# --- splits -------------------------------------------------------------------------------------------------------

HD = v.sql_hash("CAST(doc_id AS VARCHAR)")
HV = v.sql_hash("'val:' || CAST(doc_id AS VARCHAR)")


@query("train_test_split", f"SELECT doc_id, CASE WHEN {HD} % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM documents")
def _(spark, sf):
    return splits.train_test_split(v.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "train_val_test_split",
    f"SELECT doc_id, CASE WHEN {HD} % 100 < 20 THEN 'test' WHEN {HV} % 100 < 15 THEN 'val' ELSE 'train' END AS split FROM documents",
)
def _(spark, sf):
    return splits.train_val_test_split(v.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("kfold", f"SELECT doc_id, CAST({HD} % 5 AS INT) AS fold FROM documents")
def _(spark, sf):
    return splits.kfold(v.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "class_weights",
    f"""WITH {v.SCORES} SELECT label, y_true, count(*) AS n, round(sum(count(*)) OVER (PARTITION BY label) / (2::DOUBLE * count(*)), 6) AS weight
    FROM scores GROUP BY label, y_true""",
)
def _(spark, sf):
    return splits.class_weights(v.scores(spark, sf))


# --- metrics ------------------------------------------------------------------------------------------------------

CUTS = {"quality": 0.21, "toxic": 0.44}
P = "WITH " + v.PREDICTIONS
CUT_SQL = "CASE label WHEN 'quality' THEN 0.21::DOUBLE ELSE 0.44::DOUBLE END"
Q = ["id", "label", "y_true", "score", "threshold", "prediction"]


@query("sigmoid_score", "SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS score FROM embeddings")
def _(spark, sf):
    return v.embeddings(spark, sf).select("vec_id", F.round(vx.sigmoid(F.col("embedding")[0].cast("double")), 6).alias("score"))


@query("apply_thresholds", f"WITH {v.SCORES} SELECT *, {CUT_SQL} AS threshold, CAST(score > {CUT_SQL} AS INT) AS prediction FROM scores")
def _(spark, sf):
    return metrics.apply_thresholds(v.scores(spark, sf), CUTS).select(*Q)


@query("apply_thresholds_inclusive", f"WITH {v.SCORES} SELECT *, {CUT_SQL} AS threshold, CAST(score >= {CUT_SQL} AS INT) AS prediction FROM scores")
def _(spark, sf):
    return metrics.apply_thresholds(v.scores(spark, sf), CUTS, strict=False).select(*Q)


@query(
    "best_threshold",
    f"""WITH {v.SCORES}, g AS (SELECT unnest(generate_series(10, 90)) AS t),
    c AS (SELECT label, t, sum(CASE WHEN round(score * 100, 9) > t THEN y_true ELSE 0 END) AS tp, count(*) FILTER (round(score * 100, 9) > t) AS pred, sum(y_true) AS p
      FROM scores, g GROUP BY 1, 2),
    f AS (SELECT label, t, CASE WHEN pred + p = 0 THEN 0 ELSE 2::DOUBLE * tp / (pred + p) END AS f1 FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) AS rn FROM f)
    SELECT label, CASE WHEN f1 > 0 THEN t / 100::DOUBLE ELSE 0.5::DOUBLE END AS threshold, round(f1, 6) AS f1 FROM r WHERE rn = 1""",
)
def _(spark, sf):
    return metrics.best_threshold(v.scores(spark, sf))


COUNTS = "count(*) FILTER (y_true = 0 AND prediction = 0) AS tn, count(*) FILTER (y_true = 0 AND prediction = 1) AS fp, count(*) FILTER (y_true = 1 AND prediction = 0) AS fn, count(*) FILTER (y_true = 1 AND prediction = 1) AS tp"


@query("confusion_per_label", f"{P} SELECT label, {COUNTS} FROM preds GROUP BY label")
def _(spark, sf):
    return metrics.confusion_per_label(v.predictions(spark, sf))


def _rates(by):
    return f"""SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
      CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2::DOUBLE * tp / (2 * tp + fp + fn) END AS f1, tp + fn AS support FROM (SELECT {by}, {COUNTS} FROM preds GROUP BY {by})"""


RATED = f"{P}, lab AS ({_rates('label')}), smp AS ({_rates('id')})"
ROUND3 = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support"


@query(
    "per_label_report",
    f"""{RATED} SELECT name, {ROUND3} FROM (
    SELECT label AS name, precision, recall, f1, support FROM lab
    UNION ALL SELECT 'micro avg', sum(tp)::DOUBLE / sum(tp + fp), sum(tp)::DOUBLE / sum(tp + fn), 2::DOUBLE * sum(tp) / sum(2 * tp + fp + fn), sum(support) FROM lab
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM lab
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM lab
    UNION ALL SELECT 'samples avg', avg(precision), avg(recall), avg(f1), sum(support) FROM smp)""",
)
def _(spark, sf):
    return metrics.per_label_report(v.predictions(spark, sf))


@query("f1_scores", f"{RATED} SELECT round(2::DOUBLE * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro, round(avg(f1), 6) AS macro, round(sum(f1 * support) / sum(support), 6) AS weighted FROM lab")
def _(spark, sf):
    return metrics.f1_scores(v.predictions(spark, sf))


@query("label_accuracy", f"{P} SELECT label, round(avg(CASE WHEN y_true = prediction THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM preds GROUP BY 1")
def _(spark, sf):
    return metrics.label_accuracy(v.predictions(spark, sf))


@query("hamming_loss", f"{P} SELECT round(avg(CASE WHEN y_true <> prediction THEN 1.0::DOUBLE ELSE 0 END), 6) AS hamming_loss FROM preds")
def _(spark, sf):
    return metrics.hamming_loss(v.predictions(spark, sf))


@query("macro_precision_recall", f"{RATED} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM lab")
def _(spark, sf):
    return metrics.macro_precision_recall(v.predictions(spark, sf))


FOLDED = f"""{P}, fp AS (SELECT *, CAST({v.sql_hash("CAST(id AS VARCHAR)")} % 5 AS INT) AS fold FROM preds),
  lf AS (SELECT fold, label, {COUNTS} FROM fp GROUP BY 1, 2),
  fs AS (SELECT fold, 2::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) AS f1_micro, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2::DOUBLE * tp / (2 * tp + fp + fn) END) AS f1_macro,
    sum(fp + fn)::DOUBLE / sum(tn + fp + fn + tp) AS hamming_loss FROM lf GROUP BY fold),
  fr AS (SELECT fold, round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro, round(hamming_loss, 6) AS hamming_loss FROM fs)"""


def _folded(spark, sf):
    return splits.kfold(v.predictions(spark, sf), "id", 5)


@query("fold_scores", f"{FOLDED} SELECT * FROM fr")
def _(spark, sf):
    return metrics.fold_scores(_folded(spark, sf))


@query("cross_val_scores", f"{FOLDED} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std FROM fr" for m in ("f1_micro", "f1_macro", "hamming_loss")))
def _(spark, sf):
    return metrics.cross_val_scores(_folded(spark, sf))


@query(
    "error_rows",
    f"""{P}, e AS (SELECT label, CASE WHEN y_true = 1 THEN 'false negative' ELSE 'false positive' END AS kind, id FROM preds WHERE y_true <> prediction),
    r AS (SELECT *, row_number() OVER (PARTITION BY label, kind ORDER BY id) AS rn FROM e)
    SELECT label, kind, id, (SELECT score FROM preds p WHERE p.id = r.id AND p.label = 'quality') AS score_quality,
      (SELECT score FROM preds p WHERE p.id = r.id AND p.label = 'toxic') AS score_toxic FROM r WHERE rn <= 10""",
)
def _(spark, sf):
    rows = metrics.error_rows(v.predictions(spark, sf))
    return rows.select("label", "kind", "id", *[F.col("scores")[c].alias(f"score_{c}") for c in v.SCORE_LABELS])


def _stacked(spark, sf):
    """Two models over the same rows: the second reads the score upside down."""
    a = v.predictions(spark, sf).withColumn("model", F.lit("straight"))
    b = a.withColumns({"model": F.lit("inverse"), "score": 1 - F.col("score")}).withColumn("prediction", (F.col("score") > 0.4).cast("int"))
    return a.unionByName(b)


STACKED = f"""{P}, st AS (SELECT *, 'straight' AS model FROM preds UNION ALL SELECT id, label, y_true, 1 - score, CAST(1 - score > 0.4 AS INT), 'inverse' FROM preds)"""


@query(
    "model_comparison",
    f"""{STACKED}, l AS (SELECT model, label, {COUNTS} FROM st GROUP BY 1, 2)
    SELECT model, round(avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END), 6) AS precision, round(avg(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END), 6) AS recall,
      round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2::DOUBLE * tp / (2 * tp + fp + fn) END), 6) AS f1 FROM l GROUP BY model""",
)
def _(spark, sf):
    return metrics.model_comparison(_stacked(spark, sf))


@query(
    "arena",
    f"""{STACKED}, c AS (SELECT id, model, label, (CASE WHEN y_true = prediction THEN '✅ ' ELSE '❌ ' END) || (CASE WHEN prediction = 1 THEN 'OUI' ELSE 'NON' END) AS said FROM st)
    SELECT id, model, max(CASE WHEN label = 'quality' THEN said END) AS quality, max(CASE WHEN label = 'toxic' THEN said END) AS toxic FROM c GROUP BY 1, 2""",
)
def _(spark, sf):
    return metrics.arena(_stacked(spark, sf), v.SCORE_LABELS, truth=True)


@query(
    "score_batch",
    f"WITH {v.SCORES} SELECT id, label, CAST(score > {CUT_SQL} AS INT) AS prediction, score AS probability, {CUT_SQL} AS threshold FROM scores",
)
def _(spark, sf):
    packed = scoring.pack_scores(v.scores(spark, sf), CUTS)
    return packed.select("id", F.explode("result").alias("label", "r")).select("id", "label", "r.*")


@query(
    "score_batch_model",
    "SELECT doc_id AS id, l AS label, CASE l WHEN 'quality' THEN 0.21::DOUBLE ELSE 0.44::DOUBLE END AS threshold, true AS consistent "
    "FROM labels JOIN documents USING (doc_id), (VALUES ('quality'), ('toxic')) t(l)",
)
def _(spark, sf):
    vectoriser, train, _ = _prepared(spark, sf)
    fitted = classify.MultiLabelModel(vectoriser, classify.logreg_ovr(train, v.SCORE_LABELS), CUTS)
    rows = scoring.score_batch(labelled_tokens(spark, sf), fitted, "comment_id")
    each = rows.select(F.col("comment_id").alias("id"), F.explode("result").alias("label", "r")).select("id", "label", "r.*")
    consistent = (F.col("prediction") == (F.col("probability") > F.col("threshold")).cast("int")) & F.col("probability").between(0, 1)
    return each.select("id", "label", "threshold", consistent.alias("consistent"))


# --- nearest neighbours --------------------------------------------------------------------------------------------


def labelled_tokens(spark, sf):
    known = v.table(spark, sf, "labels").select("doc_id", *v.SCORE_LABELS)
    texts = v.text_table(spark, sf, "documents").select("doc_id", "text").join(known, "doc_id")
    return texts.select(F.col("doc_id").alias("comment_id"), tx.analyzer_tokens("text").alias("tokens"), *v.SCORE_LABELS)


def _truth(spark, sf):
    return v.scores(spark, sf).select("id", "label", "y_true")


LT = f"""lt AS MATERIALIZED (SELECT doc_id AS comment_id, {v.sql_tokens('text')} AS t, {HD} AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
  yt AS (SELECT doc_id AS id, 'quality' AS label, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)"""

KNN_SQL = f"""WITH {LT}, tr AS MATERIALIZED (SELECT * FROM lt WHERE h % 100 >= 20), te AS MATERIALIZED (SELECT * FROM lt WHERE h % 100 < 20), {tfidf_sql('tr')},
  qtf AS (SELECT comment_id, term, count(*) AS tf FROM (SELECT comment_id, unnest(t) AS term FROM te) GROUP BY 1, 2),
  qr AS (SELECT comment_id, term, tf * idf AS w0 FROM qtf JOIN voc USING (term)),
  qw AS (SELECT comment_id AS q, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY comment_id)) AS w FROM qr),
  dots AS (SELECT q, comment_id AS d, sum(qw.w * wt.w) AS s FROM qw JOIN wt USING (term) GROUP BY 1, 2),
  sims AS (SELECT te.comment_id AS q, tr.comment_id AS d, round(coalesce(s, 0), 9) AS sim FROM te CROSS JOIN tr LEFT JOIN dots ON q = te.comment_id AND d = tr.comment_id),
  nn AS (SELECT q, d, greatest(0, 1 - sim) AS dist, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS rn FROM sims),
  k AS (SELECT *, min(dist) OVER (PARTITION BY q) <= 1e-9 AS hit FROM nn WHERE rn <= 10),
  wv AS (SELECT q, d, CASE WHEN hit THEN CAST(dist <= 1e-9 AS INT)::DOUBLE ELSE 1 / greatest(dist, 1e-9) END AS w FROM k),
  s AS (SELECT q AS id, label, round(sum(w * y) / sum(w), 6) AS score FROM wv JOIN yt ON yt.id = wv.d GROUP BY 1, 2)"""


@query("knn_classify", f"{KNN_SQL} SELECT id, label, score, CAST(score > 0.5 AS INT) AS prediction FROM s")
def _(spark, sf):
    rows = splits.train_test_split(labelled_tokens(spark, sf), "comment_id")
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    return knn.knn_classify(train, test, _truth(spark, sf))


KNN_CV_SQL = f"""WITH {LT}, {tfidf_sql('lt')}, fw AS MATERIALIZED (SELECT wt.*, h % 5 AS f FROM wt JOIN lt USING (comment_id)),
  dots AS (SELECT a.comment_id AS q, b.comment_id AS d, sum(a.w * b.w) AS s FROM fw a JOIN fw b ON a.term = b.term AND a.f <> b.f GROUP BY 1, 2),
  sims AS (SELECT a.comment_id AS q, b.comment_id AS d, round(coalesce(s, 0), 9) AS sim FROM lt a JOIN lt b ON a.h % 5 <> b.h % 5 LEFT JOIN dots ON q = a.comment_id AND d = b.comment_id),
  nn AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS rn FROM sims),
  s AS (SELECT q AS id, label, round(avg(y::DOUBLE), 6) AS score FROM nn JOIN yt ON yt.id = nn.d WHERE rn <= 5 GROUP BY 1, 2)"""


@query("knn_cv_predict", f"{KNN_CV_SQL} SELECT id, label, score, CAST(score > 0.5 AS INT) AS prediction FROM s")
def _(spark, sf):
    rows = splits.kfold(labelled_tokens(spark, sf), "comment_id", 5)
    return knn.knn_cv_predict(rows, _truth(spark, sf))


# --- classifiers --------------------------------------------------------------------------------------------------


def _test_sql(columns):
    """Rows of the test split in long form, as every classifier query returns them."""
    one = "SELECT doc_id AS id, '{0}' AS label, {0} AS y_true, {1} FROM labels JOIN documents USING (doc_id) WHERE " + f"{HD} % 100 < 20"
    return " UNION ALL ".join(one.format(c, columns.format(c)) for c in v.SCORE_LABELS)


def _prepared(spark, sf, **terms):
    rows = splits.train_test_split(store(labelled_tokens(spark, sf), "labelled-tokens"), "comment_id")
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    vectoriser = topics.tfidf_model(train, "tokens", **({"min_df": 2} | terms))
    return vectoriser, store(vectoriser.transform(train), "labelled-features"), vectoriser.transform(test)


def _reported(fitted, test):
    scored = classify.classifier_scores(fitted, test, "comment_id", v.SCORE_LABELS)
    return scored.select("id", "label", "y_true", F.col("score").between(0, 1).alias("in_range"))


#: Largest norm of a gradient at which a fit counts as the optimum.
SMALL = 1e-3


def _linear(spark, sf, loss, params):
    """Scores of the test rows; ``converged`` comes from the gradient over all training rows, measured by plain joins."""
    rows = splits.train_test_split(store(labelled_tokens(spark, sf), "labelled-tokens"), "comment_id")
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    vocab, weights = features.tfidf_fit(train, "comment_id", F.col("tokens"), params)
    vocab, weights = store(vocab, "vocabulary"), store(weights, "weights")
    fitted = linear.fit(weights, train, "comment_id", [linear.Model(c) for c in v.SCORE_LABELS], loss)
    norms = dict(zip(v.SCORE_LABELS, linear.gradient_norms(fitted, weights, train, "comment_id")))
    scored = linear.scores(fitted, features.tfidf_transform(test, "comment_id", F.col("tokens"), vocab, params), test, "comment_id")
    small = F.create_map(*[x for c, g in norms.items() for x in (F.lit(c), F.lit(g < SMALL))])
    return scored.select("id", "label", "y_true", F.col("score").between(0, 1).alias("in_range"), small[F.col("label")].alias("converged"))


@query("logreg_ovr", _test_sql("true AS in_range, true AS converged"))
def _(spark, sf):
    return _linear(spark, sf, "logistic", TfidfParams(min_df=2))


@query("linear_svm_ovr", _test_sql("true AS in_range, true AS converged"))
def _(spark, sf):
    return _linear(spark, sf, "squared_hinge", TfidfParams(min_df=2))


@query("svm_bigrams", _test_sql("true AS in_range, true AS converged"))
def _(spark, sf):
    return _linear(spark, sf, "squared_hinge", TfidfParams(1, 2, min_df=5, max_df=0.9, stops=tuple(v.STOPS)))


@query("gbt_multi", _test_sql("true AS in_range"))
def _(spark, sf):
    rows = vectors.hashed_vectors(labelled_tokens(spark, sf), F.col("tokens"), dimensions=32)
    from pyspark.ml.functions import array_to_vector

    known = v.table(spark, sf, "labels").select(F.col("doc_id").alias("comment_id"), *v.SCORE_LABELS)
    table = rows.select("comment_id", array_to_vector("embedding").alias("features")).join(known, "comment_id")
    table = store(table, "labelled-vectors")
    split = splits.train_test_split(table, "comment_id")
    fitted = classify.gbt_multi(split.filter("split = 'train'"), v.SCORE_LABELS, trees=5, depth=3)
    return _reported(fitted, split.filter("split = 'test'"))


GRID, FOLDS = [0.01, 0.1, 1.0, 10.0], 5


@query("grid_search", " UNION ALL ".join(f"SELECT {c}::DOUBLE AS c, CAST({FOLDS} AS BIGINT) AS folds, true AS in_range, true AS converged" for c in GRID))
def _(spark, sf):
    rows = store(splits.kfold(labelled_tokens(spark, sf), "comment_id", FOLDS), "folds")
    weights = store(features.tfidf(rows, "comment_id", F.col("tokens"), TfidfParams(min_df=2)), "weights")
    fitted = linear.fit(weights, rows, "comment_id", linear.grid_models(v.SCORE_LABELS, GRID, FOLDS), fold="fold")
    norms = linear.gradient_norms(fitted, weights, rows, "comment_id", "fold")
    found = linear.grid_scores(fitted, weights, rows, "comment_id")
    return found.select("c", "folds", F.col("f1_macro").between(0, 1).alias("in_range"), F.lit(max(norms) < SMALL).alias("converged"))


@query("classifier_scores", _test_sql("CASE '{0}' WHEN 'quality' THEN 0.21::DOUBLE ELSE 0.44::DOUBLE END AS threshold, true AS consistent"))
def _(spark, sf):
    _, train, test = _prepared(spark, sf)
    scored = classify.classifier_scores(classify.logreg_ovr(train, v.SCORE_LABELS), test, "comment_id", v.SCORE_LABELS)
    cut = metrics.apply_thresholds(scored, CUTS, strict=False)
    return cut.select("id", "label", "y_true", "threshold", (F.col("prediction") == (F.col("score") >= F.col("threshold")).cast("int")).alias("consistent"))


# --- storage and streams: written to a scratch folder of this run -------------------------------------------------


def scratch(spark, name: str) -> str:
    """A fresh folder for one run: beside the cluster's checkpoints, which every executor reaches."""
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/opinio-{name}-{uuid.uuid4().hex}"


@query(
    "write_table",
    "SELECT doc_id, lang, source FROM documents",
)
def _(spark, sf):
    path = scratch(spark, "table")
    writers.write_table(v.table(spark, sf, "documents").select("doc_id", "lang", "source"), path, ["lang"])
    return readers.read_table(spark, path, ["doc_id", "lang", "source"])


@query("read_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(spark, sf):
    cols = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    rows = readers.read_table(spark, f"{sf}/orders.parquet", cols)
    return rows.filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_totalprice")


@query(
    "read_labelled",
    f"{FLAGGED} SELECT comment_id, {', '.join(RULES)} FROM nb WHERE k > 0",
)
def _(spark, sf):
    path = scratch(spark, "labelled")
    rows = store(labels.keep_any_label(flagged(spark, sf), RULES).select("comment_id", *RULES), "flagged")
    topic = rows.select("comment_id", *[(1 - F.col(c)).alias(c) for c in RULES]).withColumn("provenance", F.lit("topic"))
    writers.write_table(rows.withColumn("provenance", F.lit("regex")).unionByName(topic), path, ["provenance"])
    return readers.read_labelled(spark, path, "regex").select("comment_id", *RULES)


@query("read_reviews", f"{W} SELECT commentaire, star, client, company FROM reviews")
def _(spark, sf):
    path = scratch(spark, "csv")
    blank = F.lit(None).cast("string")
    r = v.reviews(spark, sf)
    raw = r.select(
        F.col("commentaire").alias("Commentaire"), "star", F.col("review_date").cast("string").alias("date"), "client", "reponse",
        F.lit("TrustPilot").alias("source"), "company", blank.alias("ville"), blank.alias("maj"), blank.alias("date_commande"),
        F.lit(None).cast("double").alias("ecart"),
    )
    writers.export_csv(raw, path)
    return readers.read_reviews(spark, path).select(F.col("Commentaire").alias("commentaire"), "star", "client", "company")


@query("read_gold", f"""{FLAGGED} SELECT comment_id, clean_comment, {", ".join(f"{r} AS \"{c}\"" for r, c in zip(RULES, fv.LABELS))} FROM nb""")
def _(spark, sf):
    path = scratch(spark, "gold")
    rows = flagged(spark, sf)
    text = [F.lit(None).cast("string").alias(c) for c in ("date", "client", "reponse", "source", "company", "ville", "maj", "date_commande")]
    marks = [F.col(r).alias(c) for r, c in zip(RULES, fv.LABELS)]
    gold = rows.select("comment_id", F.col("commentaire").alias("Commentaire"), "star", *text, F.lit(None).cast("double").alias("ecart"), "clean_comment", *marks)
    writers.export_csv(gold, path, sep=";")
    return readers.read_gold(spark, path, fv.LABELS).select("comment_id", "clean_comment", *fv.LABELS)


@query("export_csv", f"{FLAGGED} SELECT comment_id, {', '.join(RULES)} FROM nb WHERE k > 0")
def _(spark, sf):
    path = scratch(spark, "export")
    writers.export_csv(labels.keep_any_label(flagged(spark, sf), RULES).select("comment_id", *RULES), path)
    return spark.read.schema("comment_id bigint, " + ", ".join(f"{c} int" for c in RULES)).csv(path, header=True)


@query(
    "read_annotations",
    """SELECT CAST(label AS INT) AS topics, CASE WHEN label % 3 = 0 THEN 'service client' ELSE 'mixte' END AS "Catégorie", count(*) AS n
    FROM embeddings GROUP BY 1, 2""",
)
def _(spark, sf):
    path = scratch(spark, "sheet")
    emb = v.embeddings(spark, sf)
    sheet = emb.select(F.col("label").alias("Topic")).distinct().withColumn(
        "Catégorie", F.when(F.col("Topic") % 3 == 0, "service client").otherwise("mixte")
    )
    writers.export_csv(sheet, path)
    rows = relational.join_topic_category(emb.select(F.col("label").alias("topics")), readers.read_annotations(spark, path))
    return rows.groupBy("topics", "Catégorie").agg(F.count("*").alias("n"))


@query(
    "feature_store_gaps",
    """SELECT doc_id, 'missing' AS gap FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT vec_id, 'orphan' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""",
)
def _(spark, sf):
    stored = v.embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"))
    return feature_store.store_gaps(v.table(spark, sf, "documents").select("doc_id"), stored, "doc_id")


@query("feature_store", "SELECT doc_id, CAST(64 AS INT) AS dims FROM documents")
def _(spark, sf):
    path = scratch(spark, "vectors")
    docs = v.text_table(spark, sf, "documents").select("doc_id", "text")

    def encode(rows):
        return vectors.hashed_vectors(rows, tx.analyzer_tokens("text"), "doc_id")

    feature_store.feature_store(docs.filter(F.col("doc_id") % 2 == 0), path, encode, "doc_id")
    full = feature_store.feature_store(docs, path, encode, "doc_id")
    return full.select("doc_id", F.size("embedding").alias("dims"))


def _same(expected, got):
    """Whether two packed score tables agree, by id."""
    cell = lambda df, name: df.select(F.col("comment_id").alias("id"), F.to_json("result").alias(name))
    both = cell(expected, "a").join(cell(got, "b"), "id", "full")
    return both.select("id", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("save_load_model", "SELECT doc_id AS id, true AS same FROM labels JOIN documents USING (doc_id)")
def _(spark, sf):
    vectoriser, train, _ = _prepared(spark, sf)
    fitted = classify.MultiLabelModel(vectoriser, classify.logreg_ovr(train, v.SCORE_LABELS), CUTS)
    root = scratch(spark, "models")
    models.save_model(spark, fitted, root, "logreg", "regex")
    again = models.load_model(spark, root, "logreg", "regex")
    rows = labelled_tokens(spark, sf)
    return _same(scoring.score_batch(rows, fitted, "comment_id"), scoring.score_batch(rows, again, "comment_id"))


@query("score_stream", "SELECT doc_id AS id, true AS same FROM documents")
def _(spark, sf):
    vectoriser, train, _ = _prepared(spark, sf)
    fitted = classify.MultiLabelModel(vectoriser, classify.logreg_ovr(train, v.SCORE_LABELS), CUTS)
    inbox, out, mark = (scratch(spark, n) for n in ("inbox", "scored", "progress"))
    v.reviews(spark, sf).select("comment_id", "commentaire").write.parquet(inbox)
    arriving = streams.read_reviews_stream(spark, inbox, spark.read.parquet(inbox).schema)
    scored = streams.score_stream(arriving, fitted, lambda d: d.withColumn("tokens", tx.analyzer_tokens("commentaire")))
    streams.run_available(scored, out, mark)
    batch = scoring.score_batch(spark.read.parquet(inbox).withColumn("tokens", tx.analyzer_tokens("commentaire")), fitted, "comment_id")
    return _same(batch, spark.read.parquet(out))


@query("label_stream", f"{CLEAN}, fl AS (SELECT comment_id, {FLAGS} FROM cl) SELECT * FROM fl")
def _(spark, sf):
    inbox, out, mark = (scratch(spark, n) for n in ("inbox", "labelled", "progress"))
    v.reviews(spark, sf).select("comment_id", "commentaire").write.parquet(inbox)
    arriving = streams.read_reviews_stream(spark, inbox, spark.read.parquet(inbox).schema)
    streams.run_available(streams.label_stream(arriving, v.RULES).select("comment_id", *RULES), out, mark)
    return spark.read.parquet(out)


@query("daily_counts_stream", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def _(spark, sf):
    out, mark = scratch(spark, "days"), scratch(spark, "progress")
    source = f"{sf}/events.parquet"
    schema = spark.read.parquet(source).schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    streams.count_days(arriving, out, mark)
    return streams.daily_totals(spark, out)

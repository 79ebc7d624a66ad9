"""The three end-to-end flows over the operators: clean reviews, label them by topic, train and tune a classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..functions.fixed_values import LABELS, PRODUCT_WORDS
from ..operators import classify, clean, labels, metrics, relational, splits, topics
from ..session import store


def clean_review_table(
    raw: DataFrame,
    profile: DataFrame,
    languages: Sequence[str],
    stops: Iterable[str],
    product_words: Iterable[str] = PRODUCT_WORDS,
    lemmas: DataFrame | None = None,
    target: str = "fr",
    text: str = "commentaire",
    client: str = "client",
    id: str = "comment_id",
) -> DataFrame:
    """Raw reviews to the clean table: filled, first of each (text, client), more than three words, in the target
    language, with ``clean_comment``, ``clean_tokens`` and ``comment_sans_contexte``.

    Cheap row filters run before the costly text steps; ``id`` is the source's own key, never a row position.
    """
    rows = clean.drop_missing_text(raw, text)
    rows = clean.min_words_filter(clean.dedup_keep_first(rows, [text, client], id), text)
    rows = rows.withColumn("clean_comment", tx.clean_general(text))
    rows = clean.detect_language(rows, profile, languages, "clean_comment", id, target)
    rows = clean.filter_language(rows, target).drop("lang_detected", "lang_score")
    rows = clean.tokenize_filter(rows, "clean_comment", stops, lemmas, id=id)
    return clean.remove_product_words(rows, product_words)


def labelled_review_table(
    phrases: DataFrame, sheet: DataFrame, invariant: Sequence[str], categories: Sequence[str] = LABELS
) -> DataFrame:
    """Sentences with topics and the topic sheet to one labelled row per review."""
    joined = labels.normalize_category(relational.join_topic_category(phrases, sheet))
    known = relational.filter_known_categories(joined, categories)
    return labels.labels_by_review(labels.one_hot_labels(known, categories), invariant, categories)


def train_and_tune(
    rows: DataFrame,
    names: Sequence[str],
    fit: Callable[[DataFrame, Sequence[str]], Mapping],
    tokens: str = "tokens",
    id: str = "comment_id",
    min_df: float = 2,
) -> tuple[classify.MultiLabelModel, DataFrame]:
    """(model with thresholds tuned on the validation rows, long predictions of the untouched test rows)."""
    split = splits.train_val_test_split(store(rows, "tuned-rows"), id)
    train = split.filter("split = 'train'")
    vectoriser = topics.tfidf_model(train, tokens, min_df=min_df)
    fitted = fit(store(vectoriser.transform(train), "tuned-features"), names)
    valid = classify.classifier_scores(fitted, vectoriser.transform(split.filter("split = 'val'")), id, names)
    tuned = {r["label"]: r["threshold"] for r in metrics.best_threshold(valid).collect()}
    thresholds = {c: tuned.get(c, 0.5) for c in names}
    model = classify.MultiLabelModel(vectoriser, fitted, thresholds)
    test = classify.classifier_scores(fitted, vectoriser.transform(split.filter("split = 'test'")), id, names)
    return model, metrics.apply_thresholds(test, thresholds).withColumn("threshold", F.round("threshold", 2))

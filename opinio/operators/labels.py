"""Weak labels by keyword rules, label packing, coverage and roll-up from sentences to reviews."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hashing, text as tx
from ..functions.fixed_values import CATEGORY_ALIASES, LABEL_PATTERNS, LABELS, TOPIC_GROUPS
from .rows import explode_rows


def regex_label(df: DataFrame, rules: Mapping[str, Iterable[str]] = LABEL_PATTERNS, text: str = "clean_comment") -> DataFrame:
    """One 0/1 column per label: whether any of its patterns occurs as whole words, whatever the case."""
    return df.withColumns({label: tx.contains_term(text, tx.whole_words(p)) for label, p in rules.items()})


def matched_keywords(df: DataFrame, rules: Mapping[str, Iterable[str]] = LABEL_PATTERNS, text: str = "clean_comment") -> DataFrame:
    """One column per label with the first text part that triggers it."""
    return df.withColumns({label: tx.matched_keyword(text, tx.whole_words(p)) for label, p in rules.items()})


def _named(labels: Sequence[str]) -> list:
    return [F.col(f"`{c}`") for c in labels]


def _nb_labels(labels: Sequence[str]):
    total = F.lit(0)
    for c in _named(labels):
        total = total + F.coalesce(c, F.lit(0))
    return total


def pack_labels(df: DataFrame, labels: Sequence[str] = LABELS, out: str = "labels") -> DataFrame:
    """Label columns as one array in label order."""
    return df.withColumn(out, F.array(*_named(labels)))


def long_labels(df: DataFrame, id: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """(id, label, y_true): one row per review and label."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").cast("int").alias("y_true")) for c in labels])
    return df.select(id, F.explode(pairs).alias("_p")).select(id, "_p.label", "_p.y_true")


def _rows_with(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)``, tested on its finished rows: a plain filter is pushed below the columns it reads, and
    cleaning and rules run again for it."""
    return explode_rows(df, F.when(condition, F.array(F.lit(1))), "_with", "*").drop("_with")


def keep_any_label(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    return _rows_with(df, _nb_labels(labels) > 0)


def label_totals(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(label, n, pct): reviews with each label and their share of the reviews with any label."""
    sums = [F.coalesce(F.sum(F.col(f"`{c}`")), F.lit(0)).alias(f"_n{i}") for i, c in enumerate(labels)]
    one = df.agg(F.count_if(_nb_labels(labels) > 0).alias("_any"), *sums)
    entries = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"_n{i}").cast("bigint").alias("n")) for i, c in enumerate(labels)])
    rows = one.select("_any", F.explode(entries).alias("e")).select("_any", "e.*")
    return rows.select("label", "n", F.round(100.0 * F.col("n") / F.nullif("_any", F.lit(0)), 6).alias("pct"))


def label_cardinality(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    return df.groupBy(_nb_labels(labels).cast("int").alias("nb_labels")).agg(F.count("*").alias("n"))


def label_coverage(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """total, labelled, unlabelled, rate (percent): one row."""
    labelled = F.count_if(_nb_labels(labels) > 0)
    return df.agg(
        F.count("*").alias("total"),
        labelled.alias("labelled"),
        (F.count("*") - labelled).alias("unlabelled"),
        F.round(100.0 * labelled / F.nullif(F.count("*"), F.lit(0)), 6).alias("rate"),
    )


def browse_label(df: DataFrame, choice: str, id: str, labels: Sequence[str] = LABELS, n: int = 100, seed: int = 42) -> DataFrame:
    """Up to ``n`` pseudo-random reviews with any label (``all``), none (``none``) or the named label."""
    if choice == "all":
        rows = keep_any_label(df, labels)
    elif choice == "none":
        rows = _rows_with(df, _nb_labels(labels) == 0)
    else:
        rows = _rows_with(df, F.col(f"`{choice}`") == 1)
    return rows.orderBy(hashing.hash_number(id, F.lit(seed)), id).limit(n)


def normalize_category(df: DataFrame, category: str = "Catégorie", aliases: Mapping[str, str] = CATEGORY_ALIASES) -> DataFrame:
    """Trimmed, lower case, spelling variants mapped to their label; null stays null."""
    name = F.lower(tx.strip(category))
    known = {a.lower(): b for a, b in aliases.items()}
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    mapped = F.coalesce(F.try_element_at(F.create_map(*pairs), name), name) if pairs else name
    return df.withColumn(category, mapped)


def one_hot_labels(df: DataFrame, categories: Sequence[str] = LABELS, category: str = "Catégorie") -> DataFrame:
    return df.withColumns({c: F.coalesce((F.col(category) == c), F.lit(False)).cast("int") for c in categories})


def labels_by_review(
    df: DataFrame, invariant: Sequence[str], labels: Sequence[str] = LABELS, id: str = "comment_id", order: str = "sent_no"
) -> DataFrame:
    """One row per review: invariant columns of its first sentence, maximum of each label.

    The first non-null value in sentence order is taken, as a group-first would. Sentences are first counted as one row
    per review: with the invariant columns as keys the map side hashes them, where a minimum over texts would sort every
    sentence with the whole text of its review.
    """
    largest = [F.max(F.col(f"`{c}`")).alias(c) for c in labels]
    reviews = df.groupBy(id, *invariant).agg(F.min(order).alias("_order"), *largest)
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in invariant]
    return reviews.groupBy(id).agg(*first, *largest)


def label_set_by_review(df: DataFrame, id: str = "comment_id", category: str = "Catégorie", categories: Sequence[str] = LABELS) -> DataFrame:
    """Set of known labels per review; a review without any keeps an empty set."""
    final = F.when(F.col(category).isin(list(categories)), F.col(category))
    return df.groupBy(id).agg(F.sort_array(F.collect_set(final)).alias("labels"))


def label_set_counts(sets: DataFrame, categories: Sequence[str] = LABELS) -> DataFrame:
    """(label, n): reviews holding each label, 0 for a label that never occurs."""
    sums = [F.coalesce(F.count_if(F.array_contains("labels", c)), F.lit(0)).alias(f"_n{i}") for i, c in enumerate(categories)]
    entries = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"_n{i}").alias("n")) for i, c in enumerate(categories)])
    return sets.agg(*sums).select(F.explode(entries).alias("e")).select("e.*")


def label_set_coverage(sets: DataFrame) -> DataFrame:
    """total, labelled, unlabelled, rate (percent) over label sets."""
    labelled = F.count_if(F.size("labels") > 0)
    return sets.agg(
        F.count("*").alias("total"),
        labelled.alias("labelled"),
        (F.count("*") - labelled).alias("unlabelled"),
        F.round(100.0 * labelled / F.nullif(F.count("*"), F.lit(0)), 6).alias("rate"),
    )


def group_topics(df: DataFrame, groups: Mapping[int, Sequence[int]] = TOPIC_GROUPS, topic: str = "topic_id", out: str = "label") -> DataFrame:
    """Class of the topic-id set holding a row's topic, null for topics in no set."""
    value = F.lit(None).cast("int")
    for cls, ids in groups.items():
        value = F.when(F.col(topic).isin(list(ids)), F.lit(cls)).otherwise(value)
    return df.withColumn(out, value)


def group_topic_counts(df: DataFrame, out: str = "label") -> DataFrame:
    """Rows per class, the null class counted too."""
    return df.groupBy(out).agg(F.count("*").alias("n"))

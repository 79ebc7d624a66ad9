"""Joins, unions, top-k, head and reproducible samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import hashing
from ..functions.fixed_values import LABELS
from ..session import broadcast_if_small


def join_topic_category(
    phrases: DataFrame, sheet: DataFrame, topics: str = "topics", topic: str = "Topic", category: str = "Catégorie"
) -> DataFrame:
    """Every phrase with the category of its topic, null when the sheet has none.

    The sheet's rows are counted, for Spark cannot size one made of local rows and would rather move the phrases: a
    small one is broadcast, a larger one shuffled.
    """
    side = broadcast_if_small(sheet.select(F.col(topic).alias("_topic"), F.col(category)))
    return phrases.join(side, phrases[topics] == side["_topic"], "left").drop("_topic")


def map_topic_category(
    phrases: DataFrame, mapping: Mapping[int, str | None], topics: str = "topics", out: str = "categorie_detectee"
) -> DataFrame:
    """The same lookup from an in-memory dictionary: a constant map, no join."""
    known = [(k, c) for k, c in mapping.items() if c is not None]
    pairs = [F.lit(x) for pair in known for x in pair]
    value = F.try_element_at(F.create_map(*pairs), F.col(topics)) if pairs else F.lit(None).cast("string")
    return phrases.withColumn(out, value)


def filter_known_categories(df: DataFrame, categories: Sequence[str] = LABELS, category: str = "Catégorie") -> DataFrame:
    return df.filter(F.col(category).isin(list(categories)))


def concat_samples(parts: Mapping[str, DataFrame], tag: str = "label") -> DataFrame:
    """Union of named frames with the name in a tag column."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def top_k(df: DataFrame, metric: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(metric), key).limit(k)


def head_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def _first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; Spark keeps ``n`` per group and task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def head_per_group(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    return _first_per_group(df, [group], [F.col(c) for c in order], n)


def sample_n(df: DataFrame, n: int, id: str, seed: int = 42) -> DataFrame:
    """``n`` pseudo-random rows, the same for a seed on every run and partitioning."""
    return df.orderBy(hashing.hash_number(id, F.lit(seed)), id).limit(n)


def sample_per_label(df: DataFrame, labels: Sequence[str], n: int, id: str, seed: int = 42) -> DataFrame:
    """Up to ``n`` pseudo-random rows of each label; a row with several labels may be drawn for each."""
    drawn = F.filter(F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in labels]), lambda x: x.isNotNull())
    rows = df.withColumn("label", F.explode(drawn))
    return _first_per_group(rows, ["label"], [hashing.hash_number(id, F.lit(seed)), F.col(id)], n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def review_lookup(
    phrases: DataFrame, comment_id: int, categories: Sequence[str] = LABELS, category: str = "Catégorie"
) -> DataFrame:
    """Text, sentences, categories and final labels of one review; the filter reaches the scan."""
    one = phrases.filter(F.col("comment_id") == comment_id)
    final = F.when(F.col(category).isin(list(categories)), F.col(category))
    return one.groupBy("comment_id").agg(
        F.min_by("commentaire", "sent_no").alias("commentaire"),
        F.sort_array(F.collect_list(F.struct("sent_no", "sentence")))["sentence"].alias("sentences"),
        F.sort_array(F.collect_set(category)).alias("categories"),
        F.sort_array(F.collect_set(final)).alias("final_labels"),
    )


def topic_lookup(
    phrases: DataFrame,
    topic_words: DataFrame,
    topic: int,
    n: int = 50,
    categories: Sequence[str] = LABELS,
    category: str = "Catégorie",
) -> DataFrame:
    """First ``n`` sentences of one topic with its words, category and final label."""
    words = (
        topic_words.filter(F.col("topic") == topic)
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", "word")))["word"], ", ").alias("w"))
        .scalar()
    )
    first = phrases.filter(F.col("topics") == topic).orderBy("comment_id", "sent_no").limit(n)
    return first.select(
        F.col("topics").alias("topic"),
        words.alias("words"),
        F.col(category).alias("category"),
        F.when(F.col(category).isin(list(categories)), F.col(category)).alias("final_label"),
        "comment_id",
        "sent_no",
        "sentence",
        "star",
    )

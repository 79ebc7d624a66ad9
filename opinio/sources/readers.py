"""Readers with declared schemas: no inference pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("Commentaire", T.StringType()),
        T.StructField("star", T.IntegerType()),
        T.StructField("date", T.StringType()),
        T.StructField("client", T.StringType()),
        T.StructField("reponse", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("ville", T.StringType()),
        T.StructField("maj", T.StringType()),
        T.StructField("date_commande", T.StringType()),
        T.StructField("ecart", T.DoubleType()),
    ]
)


def gold_schema(labels: Sequence[str]) -> T.StructType:
    fields = [T.StructField("comment_id", T.LongType()), *REVIEW_SCHEMA.fields, T.StructField("clean_comment", T.StringType())]
    return T.StructType(fields + [T.StructField(c, T.IntegerType()) for c in labels])


def _csv(spark: SparkSession, path: str, schema: T.StructType, sep: str) -> DataFrame:
    """Headered CSV whose quoted texts may hold separators, doubled quotes and line breaks."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Raw reviews. Multi-line CSV is split by file only: keep the files small or convert once to parquet."""
    return _csv(spark, path, REVIEW_SCHEMA, ",")


def read_gold(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame:
    """Hand-labelled reviews, ``;``-separated."""
    return _csv(spark, path, gold_schema(labels), ";")


def read_labelled(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """Labelled reviews of one provenance (``topic`` or ``regex``): a partition filter, other files unread."""
    if mode not in ("topic", "regex"):
        raise ValueError("mode must be 'topic' or 'regex'")
    return spark.read.parquet(path).filter(F.col("provenance") == mode)


def read_annotations(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Topic sheet with the category a person gave each topic."""
    schema = T.StructType([T.StructField("Topic", T.IntegerType()), T.StructField("Catégorie", T.StringType())])
    return _csv(spark, path, schema, sep)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_topic_words(spark: SparkSession, path: str) -> DataFrame:
    """Topic file (``Topic``, comma-separated ``Words``) as (topic, rank, word), ranks from 1."""
    schema = T.StructType([T.StructField("Topic", T.IntegerType()), T.StructField("Words", T.StringType())])
    return rank_words(_csv(spark, path, schema, ","))


def rank_words(df: DataFrame, topic: str = "Topic", words: str = "Words") -> DataFrame:
    exploded = df.select(F.col(topic).alias("topic"), F.posexplode(F.split(words, r",\s*")).alias("pos", "word"))
    return exploded.select("topic", (F.col("pos") + 1).alias("rank"), F.trim("word").alias("word"))


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a table stored in fewer pieces than there are cores; otherwise leave it alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

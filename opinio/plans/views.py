"""The driver tables seen as reviews, sentences, topics and scores, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hashing, text as tx
from ..operators import clean
from ..sources import readers

BLANK = tx.BLANK
WORD = tx.WORD

# Parameters of the registered queries: stop words of the corpus and a small rule table over words it holds.
STOPS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "be", "as", "by", "this",
    "are", "at", "from", "de", "la", "que", "le", "en", "des", "et", "les", "un", "el", "ou", "du",
    "der", "die", "und", "den", "von",
]
DOMAIN_WORDS = ["tion", "ment", "keit", "ing", "eau", "elle", "ich", "ung"]
RULES = {"anglais": ["the", "and|with"], "roman": ["que(s)?", "pour", "une"], "allemand": ["und", "nicht", r"die\s+der"]}
LANGUAGES = ["de", "en", "es", "fr"]
SCORE_LABELS = ["quality", "toxic"]
TOPIC_CATEGORIES = {
    -1: None, 0: "Qualité Produit", 1: "Service livraison", 2: " Service Client ", 3: "mixte", 4: "qualité produit",
    5: "Service Livraison", 6: None, 7: "Qualité produit", 8: "autre", 9: "Service client", 10: "service livraison",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return readers.read_table(spark, f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose texts cost more to process than to move."""
    return readers.spread(table(spark, sf, name))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    d = text_table(spark, sf, "documents")
    doc = F.col("doc_id")
    return d.select(
        doc.alias("comment_id"),
        F.col("text").alias("commentaire"),
        (doc % 5 + 1).cast("int").alias("star"),
        F.when(doc % 11 != 0, F.date_add(F.lit("2020-01-01").cast("date"), ((doc * 37) % 730).cast("int"))).alias(
            "review_date"
        ),
        F.concat(F.lit("c"), (doc % 97).cast("string")).alias("client"),
        F.when(doc % 3 != 0, F.lit("ok")).alias("reponse"),
        F.col("source").alias("company"),
        "lang",
    )


REVIEWS = """reviews AS (
  SELECT doc_id AS comment_id, text AS commentaire, CAST(doc_id % 5 + 1 AS INT) AS star,
         CASE WHEN doc_id % 11 = 0 THEN NULL
              ELSE CAST(DATE '2020-01-01' + CAST((doc_id * 37) % 730 AS INT) AS DATE) END AS review_date,
         concat('c', CAST(doc_id % 97 AS VARCHAR)) AS client,
         CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'ok' END AS reponse,
         source AS company, lang
  FROM documents)"""


def lit(values) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def sql_word_count(c: str) -> str:
    bare = rf"regexp_replace({c}, '[^{WORD}{BLANK}]', '', 'g')"
    return rf"CAST(len(list_filter(regexp_split_to_array({bare}, '[{BLANK}]+'), lambda x: x <> '')) AS INT)"


def sql_clean(c: str) -> str:
    out = sql_strip(f"lower({c})")
    for pattern in (rf"(http|www)[^{BLANK}]+", rf"[^{BLANK}]+@[^{BLANK}]+", rf"(@|#)[{WORD}]+"):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return sql_strip(rf"regexp_replace({out}, '[{BLANK}]+', ' ', 'g')")


def sql_tokens(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[{WORD}]{{2,}}')"


def sql_letter_tokens(c: str, stops=STOPS, min_length: int = 3) -> str:
    return (
        rf"list_filter(regexp_extract_all(lower({c}), '[{WORD}]+'), "
        rf"lambda x: regexp_full_match(x, '\p{{L}}+') AND length(x) >= {min_length} AND x NOT IN ({lit(stops)}))"
    )


def sql_sentences(c: str) -> str:
    marked = rf"regexp_replace({c}, '([.!?…])[{BLANK}]+', '\1' || chr(1), 'g')"
    trimmed = rf"list_transform(string_split({marked}, chr(1)), lambda s: {sql_strip('s')})"
    return rf"list_filter({trimmed}, lambda s: regexp_matches(s, '\p{{L}}'))"


def sql_hash(key: str) -> str:
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"


def clean_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return reviews(spark, sf).withColumn("clean_comment", tx.clean_general("commentaire"))


def token_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return clean.tokenize_filter(reviews(spark, sf), "commentaire", STOPS)


TOKENS = REVIEWS + f""",
toks AS (SELECT comment_id, star, company, {sql_letter_tokens('commentaire')} AS clean_tokens FROM reviews)"""


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return clean.explode_sentences(
        clean_reviews(spark, sf), keep=["comment_id", "commentaire", "star", "company", "client"]
    )


SENTENCES = REVIEWS + f""",
sents_raw AS (
  SELECT comment_id, commentaire, star, company, client, {sql_sentences(sql_clean('commentaire'))} AS parts FROM reviews),
sents_all AS (
  SELECT comment_id, commentaire, star, company, client, unnest(parts) AS sentence,
         CAST(generate_subscripts(parts, 1) - 1 AS INT) AS sent_no FROM sents_raw),
sentences AS (SELECT * FROM sents_all WHERE {sql_word_count('sentence')} > 3)"""


def topic_of(comment_id, sent_no):
    return ((comment_id * 7 + sent_no) % 12 - 1).cast("int")


def phrase_topics(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(spark, sf).withColumn("topics", topic_of(F.col("comment_id"), F.col("sent_no")))


PHRASES = SENTENCES + """,
phrases AS (SELECT *, CAST((comment_id * 7 + sent_no) % 12 - 1 AS INT) AS topics FROM sentences)"""


def topic_sheet(spark: SparkSession) -> DataFrame:
    """The hand-filled topic sheet: one row per topic."""
    rows = [(t, c) for t, c in TOPIC_CATEGORIES.items()]
    return spark.createDataFrame(rows, "Topic int, `Catégorie` string")


SHEET = "sheet AS (SELECT * FROM (VALUES " + ", ".join(
    f"({t}, {'NULL' if c is None else lit([c])})" for t, c in TOPIC_CATEGORIES.items()
) + ') v(Topic, cat))'


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(id, label, y_true, score): true labels with a synthetic score."""
    wide = table(spark, sf, "labels")
    long = wide.select(
        F.col("doc_id").alias("id"), F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (label, y_true)")
    )
    bucket = hashing.hash_bucket(1000, F.concat(F.col("id").cast("string"), F.col("label")))
    return long.select("id", "label", F.col("y_true").cast("int").alias("y_true"), (bucket / 1000.0).alias("score"))


SCORES = f"""scores AS (
  SELECT id, label, CAST(y_true AS INT) AS y_true,
         ({sql_hash("CAST(id AS VARCHAR) || label")} % 1000) / 1000.0::DOUBLE AS score
  FROM (SELECT doc_id AS id, 'quality' AS label, quality AS y_true FROM labels
        UNION ALL SELECT doc_id, 'toxic', toxic FROM labels))"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).withColumn("prediction", (F.col("score") > 0.4).cast("int"))


PREDICTIONS = SCORES + ", preds AS (SELECT *, CAST(score > 0.4 AS INT) AS prediction FROM scores)"


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")

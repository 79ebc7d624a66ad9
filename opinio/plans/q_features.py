"""Queries over word, n-gram, TF-IDF and vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text as tx, vectors as vx
from ..operators import features, vectors
from ..operators.features import TfidfParams
from ..operators.rows import explode_rows
from . import views as v
from .q_profile import CLEANED
from .registry import query

W = "WITH " + v.REVIEWS


def _letters(spark, sf):
    rows = v.reviews(spark, sf)
    return rows.select("comment_id", "star", tx.clean_letters_stop("commentaire", v.STOPS).alias("t"))


WORDS = f"{CLEANED}, ex AS (SELECT comment_id, star, unnest(string_split(t, ' ')) AS term FROM w WHERE t <> '')"


@query("word_freq", f"{WORDS} SELECT term, count(*) AS n FROM ex GROUP BY term ORDER BY n DESC, term LIMIT 20")
def _(spark, sf):
    return features.word_freq(_letters(spark, sf), tx.words("t"), 20)


_by = """, c AS (SELECT {b} AS bucket, term, count(*) AS n FROM ex GROUP BY 1, 2),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY n DESC, term) AS INT) AS rank FROM c WHERE bucket IS NOT NULL)
 SELECT bucket, term, n, rank FROM r WHERE rank <= {k}"""


@query("word_freq_by_star", WORDS.replace(", c AS (SELECT star", ", cc AS (SELECT star").replace("FROM c)", "FROM cc)") + _by.format(b="CASE WHEN star <= 2 THEN 'bad' WHEN star >= 4 THEN 'good' END", k=200))
def _(spark, sf):
    return features.word_freq_by_star(_letters(spark, sf), tx.words("t"))


@query("word_freq_per_star", WORDS.replace(", c AS (SELECT star", ", cc AS (SELECT star").replace("FROM c)", "FROM cc)") + _by.format(b="star", k=50))
def _(spark, sf):
    return features.word_freq_by_star(_letters(spark, sf), tx.words("t"), k=50, grouped=False)


def sql_ngrams(tokens: str, low: int, high: int) -> str:
    parts = [
        tokens
        if n == 1
        else f"list_transform(generate_series(1, len({tokens}) - {n - 1}), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"
        for n in range(low, high + 1)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


STOPPED = f"{W}, tk AS MATERIALIZED (SELECT comment_id, star, commentaire, list_filter({v.sql_tokens('commentaire')}, lambda x: x NOT IN ({v.lit(v.STOPS)})) AS t FROM reviews)"


def _ngram_sql(low, high, k):
    return f"""ng AS (SELECT ngram, count(*) AS n FROM (SELECT unnest({sql_ngrams('t', low, high)}) AS ngram FROM tk)
      GROUP BY ngram ORDER BY n DESC, ngram LIMIT {k})"""


@query("ngram_counts", f"{STOPPED}, {_ngram_sql(2, 3, 20)} SELECT ngram, n FROM ng")
def _(spark, sf):
    return features.ngram_counts(v.reviews(spark, sf), "commentaire", v.STOPS, 2, 3, 20)


@query("ngram_counts_bigrams", f"{STOPPED}, {_ngram_sql(2, 2, 15)} SELECT ngram, n FROM ng")
def _(spark, sf):
    return features.ngram_counts(v.reviews(spark, sf), "commentaire", v.STOPS, 2, 2, 15)


@query("ngram_counts_trigrams", f"{STOPPED}, {_ngram_sql(3, 3, 15)} SELECT ngram, n FROM ng")
def _(spark, sf):
    return features.ngram_counts(v.reviews(spark, sf), "commentaire", v.STOPS, 3, 3, 15)


@query(
    "ngram_star_distribution",
    f"""{W}, tk AS (SELECT {v.sql_tokens('commentaire')} AS t FROM reviews), {_ngram_sql(2, 3, 20)}
    SELECT ngram, star, count(*) AS n FROM reviews JOIN ng ON contains(lower(commentaire), ngram) GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = v.reviews(spark, sf)
    return features.ngram_star_distribution(rows, features.ngram_counts(rows, "commentaire", (), 2, 3, 20))


def tfidf_sql(source: str, low=1, high=1, min_df=1, max_df=1.0, max_features=None, prefix="", idcol="comment_id") -> str:
    """CTEs {prefix}tf, {prefix}voc, {prefix}wt over ``source(idcol, t)``."""
    p = prefix
    limit = f"ORDER BY cf DESC, term LIMIT {max_features}" if max_features else ""
    return f"""{p}tf AS (SELECT {idcol}, term, count(*) AS tf FROM (SELECT {idcol}, unnest({sql_ngrams('t', low, high)}) AS term FROM {source}) GROUP BY 1, 2),
    {p}nd AS (SELECT count(*)::DOUBLE AS n FROM {source}),
    {p}voc AS (SELECT term, df, cf, ln((1 + n) / (1 + df)) + 1 AS idf FROM
       (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {p}tf GROUP BY term), {p}nd
       WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * n {limit}),
    {p}raw AS (SELECT {idcol}, term, tf * idf AS w0 FROM {p}tf JOIN {p}voc USING (term)),
    {p}wt AS (SELECT {idcol}, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY {idcol})) AS w FROM {p}raw)"""


def tokens(spark, sf):
    return v.reviews(spark, sf).select("comment_id", tx.analyzer_tokens("commentaire").alias("t"))


TK = f"{W}, tk AS MATERIALIZED (SELECT comment_id, {v.sql_tokens('commentaire')} AS t FROM reviews)"


@query("tfidf", f"{TK}, {tfidf_sql('tk', min_df=5, max_df=0.95)} SELECT comment_id, term, round(w, 6) AS w FROM wt")
def _(spark, sf):
    w = features.tfidf(tokens(spark, sf), "comment_id", F.col("t"), TfidfParams(min_df=5, max_df=0.95))
    return w.withColumn("w", F.round("w", 6))


@query("tfidf_bigrams", f"{STOPPED}, {tfidf_sql('tk', 1, 2, max_features=5000)} SELECT comment_id, term, round(w, 6) AS w FROM wt")
def _(spark, sf):
    params = TfidfParams(1, 2, max_features=5000, stops=tuple(v.STOPS))
    return features.tfidf(tokens(spark, sf), "comment_id", F.col("t"), params).withColumn("w", F.round("w", 6))


@query("tfidf_top_terms", f"{STOPPED}, {tfidf_sql('tk', max_features=50)} SELECT term, round(sum(w), 6) AS score FROM wt GROUP BY term ORDER BY score DESC, term LIMIT 20")
def _(spark, sf):
    params = TfidfParams(max_features=50, stops=tuple(v.STOPS))
    return features.tfidf_top_terms(features.tfidf(tokens(spark, sf), "comment_id", F.col("t"), params), 20)


@query(
    "tfidf_top_terms_mean",
    f"""{TK}, {tfidf_sql('tk', min_df=5, max_df=0.95)} SELECT term, round(sum(w) / max(n), 6) AS score FROM wt, nd GROUP BY term ORDER BY score DESC, term LIMIT 20""",
)
def _(spark, sf):
    rows = tokens(spark, sf)
    w = features.tfidf(rows, "comment_id", F.col("t"), TfidfParams(min_df=5, max_df=0.95))
    return features.tfidf_top_terms(w, 20, rows.agg(F.count("*")).scalar())


@query(
    "tfidf_transform",
    f"""{TK}, {tfidf_sql('tk', min_df=2)}, btk AS (SELECT item_id, {v.sql_tokens('text')} AS t FROM benchmark),
    btf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(t) AS term FROM btk) GROUP BY 1, 2),
    braw AS (SELECT item_id, term, tf * idf AS w0 FROM btf JOIN voc USING (term))
    SELECT item_id, term, round(w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY item_id)), 6) AS w FROM braw""",
)
def _(spark, sf):
    vocab, _ = features.tfidf_fit(tokens(spark, sf), "comment_id", F.col("t"), TfidfParams(min_df=2))
    new = v.table(spark, sf, "benchmark")
    return features.tfidf_transform(new, "item_id", tx.analyzer_tokens("text"), vocab).withColumn("w", F.round("w", 6))


@query(
    "l2_normalize",
    """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(x::DOUBLE / n * 1000000) AS BIGINT) AS VARCHAR)), ',') AS unit
    FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)""",
)
def _(spark, sf):
    unit = vectors.l2_normalize(v.embeddings(spark, sf).select("vec_id", "embedding"), "embedding", "u")
    micro = F.transform("u", lambda x: F.round(x * 1000000).cast("bigint").cast("string"))
    return unit.select("vec_id", F.array_join(micro, ",").alias("unit"))


# Word vectors for the vector queries: every token borrows the embedding at its hash.
VOCAB_SQL = f"""tw_tok AS (SELECT comment_id, unnest({v.sql_tokens('commentaire')}) AS term FROM reviews),
  nvec AS (SELECT count(*) AS n FROM embeddings),
  wv AS (SELECT term, embedding AS vector FROM (SELECT term, {v.sql_hash('term')} % n AS vec_id FROM
     (SELECT DISTINCT term FROM tw_tok WHERE true), nvec) JOIN embeddings USING (vec_id))"""


def word_vecs(spark, sf):
    words = explode_rows(v.reviews(spark, sf), tx.analyzer_tokens("commentaire"), "term")
    words = words.distinct()
    vecs = v.embeddings(spark, sf)
    slot = hashing.hash_number("term") % vecs.agg(F.count("*")).scalar()
    return words.withColumn("vec_id", slot).join(vecs, "vec_id").select("term", F.col("embedding").alias("vector"))


def _long(df, id):
    """Vector cells as rows, rounded: arrays of doubles are compared cell by cell."""
    return df.select(id, F.posexplode("embedding").alias("dim", "x")).select(id, "dim", F.round("x", 6).alias("x"))


MEAN_SQL = """cells AS (SELECT comment_id, u.d AS dim, avg(vector[u.d]::DOUBLE) AS m FROM tw_tok JOIN wv USING (term), (SELECT unnest(generate_series(1, 64)) AS d) u GROUP BY 1, 2),
  unit AS (SELECT comment_id, dim, m / sqrt(sum(m * m) OVER (PARTITION BY comment_id)) AS x FROM cells)
  SELECT comment_id, CAST(g.d - 1 AS INT) AS dim, round(coalesce(x, 0), 6) AS x FROM reviews CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS d) g
  LEFT JOIN unit USING (comment_id) WHERE unit.dim IS NULL OR unit.dim = g.d"""


@query("doc_vector_mean", f"{W}, {VOCAB_SQL}, {MEAN_SQL}")
def _(spark, sf):
    return _long(vectors.doc_vector_mean(tokens(spark, sf), word_vecs(spark, sf), F.col("t"), dimensions=64), "comment_id")


@query("pretrained_vectors", f"{W}, {VOCAB_SQL.replace('WHERE true', 'WHERE term NOT IN (' + v.lit(v.STOPS) + ')')}, {MEAN_SQL}")
def _(spark, sf):
    from .q_labels import scratch

    path = scratch(spark, "word-lines")
    lines = word_vecs(spark, sf).filter(~F.col("term").isin(v.STOPS))
    lines.select(F.concat_ws(" ", "term", F.transform("vector", lambda x: x.cast("double").cast("string")))).write.text(path)
    known = vectors.pretrained_vectors(spark, path)
    return _long(vectors.doc_vector_mean(tokens(spark, sf), known, F.col("t"), dimensions=64), "comment_id")


PAIR_WORDS = ["the", "and", "of", "que", "und", "la", "der", "re", "nt", "et"]


@query(
    "cosine_pairs",
    f"""{W}, {VOCAB_SQL} SELECT a.term AS term_a, b.term AS term_b, round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 6) AS cosine
    FROM wv a, wv b WHERE a.term IN ({v.lit(PAIR_WORDS)}) AND b.term IN ({v.lit(PAIR_WORDS)})""",
)
def _(spark, sf):
    return vectors.cosine_pairs(word_vecs(spark, sf), PAIR_WORDS)


def _shape(df, id):
    """Dimensions and length of each vector: what any engine can tell of an encoder's result."""
    return df.select(id, F.size("embedding").alias("dims"), F.round(vx.norm("embedding"), 5).alias("norm"))


@query(
    "embed_texts",
    f"""WITH {v.REVIEWS} SELECT comment_id, CAST(64 AS INT) AS dims,
    CASE WHEN regexp_matches({v.sql_clean('commentaire')}, '[{v.WORD}]{{2}}') THEN 1.0::DOUBLE ELSE 0 END AS norm FROM reviews""",
)
def _(spark, sf):
    rows = v.clean_reviews(spark, sf)
    return _shape(vectors.embed_texts(rows, lambda: vectors.hashing_encoder(64)), "comment_id")


@query(
    "embed_sentences",
    f"""WITH {v.SENTENCES} SELECT concat(comment_id, ':', sent_no) AS key, CAST(64 AS INT) AS dims,
    CASE WHEN regexp_matches(sentence, '[{v.WORD}]{{2}}') THEN 1.0::DOUBLE ELSE 0 END AS norm FROM sentences""",
)
def _(spark, sf):
    rows = v.sentences(spark, sf).withColumn("key", F.concat_ws(":", "comment_id", "sent_no"))
    return _shape(vectors.hashed_vectors(rows, tx.analyzer_tokens("sentence"), "key", 64), "key")


@query("word2vec_train", f"WITH {v.TOKENS} SELECT term, CAST(300 AS INT) AS dims FROM (SELECT unnest(clean_tokens) AS term FROM toks) GROUP BY term HAVING count(*) >= 5")
def _(spark, sf):
    rows = v.token_reviews(spark, sf).select("clean_tokens")
    return vectors.word_vectors(vectors.word2vec_train(rows, "clean_tokens")).select("term", F.size("vector").alias("dims"))

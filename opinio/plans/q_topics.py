"""Queries over topic models, topic words, vectors, clusters and coherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import density, linkage, quality, subclusters, topics, vectors
from ..operators.rows import explode_rows
from ..session import store
from . import views as v
from .q_features import VOCAB_SQL, sql_ngrams, word_vecs
from .q_profile import TOPIC_WORDS
from .registry import query

W = "WITH " + v.REVIEWS


def phrase_topic_words(spark, sf, n):
    """(topic, rank, word, score): commonest words of each phrase topic."""
    rows = explode_rows(v.phrase_topics(spark, sf), _phrase_tokens("sentence"), "term", F.col("topics").alias("topic"))
    counts = rows.groupBy("topic", "term").agg(F.count("*").cast("double").alias("weight"))
    return topics.topic_top_words(counts, n).select("topic", "rank", F.col("term").alias("word"), F.col("weight").alias("score"))


def _phrase_tokens(c):
    kept = F.filter(tx.letter_tokens(c), lambda t: F.length(t) >= 3)
    return tx.drop_words(kept, v.STOPS)


def TW(n):  # noqa: N802
    return "WITH " + v.PHRASES + ", " + TOPIC_WORDS.format(tok=v.sql_letter_tokens("sentence"), n=n)


@query("topic_top_words", f"{TW(15)} SELECT topic, CAST(rank AS INT) AS rank, word FROM tw")
def _(spark, sf):
    return phrase_topic_words(spark, sf, 15).select("topic", "rank", "word")


DIST = """dist AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS topic_dist FROM embeddings)"""


@query(
    "dominant_topic",
    f"""WITH {DIST} SELECT vec_id, CAST(list_position(topic_dist, list_max(topic_dist)) - 1 AS INT) AS topic_id,
    round(list_max(topic_dist), 6) AS topic_confidence FROM dist""",
)
def _(spark, sf):
    shares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    rows = topics.dominant_topic(v.embeddings(spark, sf).select("vec_id", shares.alias("topic_dist")))
    return rows.select("vec_id", "topic_id", F.round("topic_confidence", 6).alias("topic_confidence"))


@query("topic_sizes", f"WITH {v.PHRASES} SELECT topics, count(*) AS n FROM phrases GROUP BY 1")
def _(spark, sf):
    return topics.topic_sizes(v.phrase_topics(spark, sf))


@query("topic_share", f"WITH {v.PHRASES} SELECT topics, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM phrases GROUP BY 1")
def _(spark, sf):
    return topics.topic_share(v.phrase_topics(spark, sf))


STOPPED_PHRASES = f"""WITH {v.PHRASES}, st AS MATERIALIZED (SELECT comment_id, sent_no, topics AS topic,
  list_filter({v.sql_tokens('sentence')}, lambda x: x NOT IN ({v.lit(v.STOPS)})) AS t FROM phrases),
  cnt AS (SELECT topic, term, count(*) AS tf FROM (SELECT topic, unnest({sql_ngrams('t', 1, 3)}) AS term FROM st) GROUP BY 1, 2)"""

CTFIDF = f"""{STOPPED_PHRASES}, pt AS (SELECT term, sum(tf) AS f, count(*) AS classes FROM cnt GROUP BY term),
  kept AS (SELECT cnt.*, f FROM cnt JOIN pt USING (term) WHERE classes <= 0.95::DOUBLE * (SELECT count(DISTINCT topics) FROM phrases)),
  sz AS (SELECT topic, sum(tf) AS size FROM kept GROUP BY 1),
  wt AS (SELECT topic, term, round((tf::DOUBLE / size) * ln(1 + (SELECT floor(avg(size)) FROM sz) / f::DOUBLE), 9) AS weight FROM kept JOIN sz USING (topic)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM wt)"""


def _ctfidf(spark, sf):
    rows = v.phrase_topics(spark, sf).select("topics", tx.analyzer_tokens("sentence").alias("t"))
    return topics.ctfidf(rows, "t", stops=v.STOPS).withColumn("weight", F.round("weight", 9))


@query("ctfidf", f"{CTFIDF} SELECT topic, CAST(rank AS INT) AS rank, term, round(weight, 7) AS weight FROM rk WHERE rank <= 15")
def _(spark, sf):
    return topics.topic_top_words(_ctfidf(spark, sf), 15).withColumn("weight", F.round("weight", 7))


@query(
    "topic_word_barchart_data",
    f"""{CTFIDF}, big AS (SELECT topics AS topic FROM phrases WHERE topics <> -1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
    SELECT topic, CAST(rank AS INT) AS rank, term, round(weight, 7) AS weight FROM rk WHERE rank <= 5 AND topic IN (SELECT topic FROM big)""",
)
def _(spark, sf):
    rows = topics.topic_word_barchart_data(_ctfidf(spark, sf), v.phrase_topics(spark, sf))
    return rows.withColumn("weight", F.round("weight", 7))


@query(
    "topic_tfidf_words",
    f"""{STOPPED_PHRASES}, dt AS (SELECT comment_id, sent_no, topic, term, count(*) AS tf FROM
      (SELECT comment_id, sent_no, topic, unnest({sql_ngrams('t', 1, 3)}) AS term FROM st WHERE topic <> -1) GROUP BY 1, 2, 3, 4),
    nd AS (SELECT topic, count(*) AS n FROM st GROUP BY 1),
    idf AS (SELECT topic, term, ln((1 + max(n))::DOUBLE / (1 + count(*))) + 1 AS idf FROM dt JOIN nd USING (topic) GROUP BY 1, 2),
    raw AS (SELECT *, tf * idf AS w0 FROM dt JOIN idf USING (topic, term)),
    nrm AS (SELECT topic, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY comment_id, sent_no)) AS w FROM raw),
    s AS (SELECT topic, term, round(sum(w), 6) AS score FROM nrm GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM s)
    SELECT topic, CAST(rank AS INT) AS rank, term AS word, score FROM r WHERE rank <= 10""",
)
def _(spark, sf):
    rows = v.phrase_topics(spark, sf).select(
        F.concat_ws(":", "comment_id", "sent_no").alias("key"), "topics", tx.analyzer_tokens("sentence").alias("t")
    )
    return topics.topic_tfidf_words(rows, "key", "t", stops=v.STOPS)


CENTRES = """cells AS (SELECT label, d, avg(embedding[d]::DOUBLE) AS m FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS d) GROUP BY 1, 2),
  cent AS (SELECT label AS topic, list(m ORDER BY d) AS vec FROM cells GROUP BY 1)"""


def _centres(spark, sf):
    return topics.topic_vectors(v.embeddings(spark, sf), "label")


@query("topic_vectors", f"WITH {CENTRES} SELECT label AS topic, CAST(d - 1 AS INT) AS dim, round(m, 6) AS x FROM cells")
def _(spark, sf):
    return _centres(spark, sf).select("topic", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(
    "topic_reassign",
    f"""WITH {CENTRES}, s AS (SELECT vec_id, topic, list_cosine_similarity(embedding::DOUBLE[], vec) AS sim FROM embeddings, cent)
    SELECT vec_id, arg_max(topic, sim) AS topic, round(max(sim), 6) AS similarity FROM s GROUP BY vec_id""",
)
def _(spark, sf):
    rows = topics.topic_reassign(v.embeddings(spark, sf), _centres(spark, sf), "vec_id")
    return rows.withColumn("similarity", F.round("similarity", 6))


@query(
    "topic_nearest_words",
    f"""{W}, {VOCAB_SQL}, {CENTRES}, s AS (SELECT topic, term, round(list_cosine_similarity(vector::DOUBLE[], vec), 6) AS weight FROM wv, cent),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM s)
    SELECT topic, CAST(rank AS INT) AS rank, term, weight FROM r WHERE rank <= 20""",
)
def _(spark, sf):
    return topics.topic_nearest_words(word_vecs(spark, sf), _centres(spark, sf), 20)


@query(
    "topic_similarity",
    f"""WITH {CENTRES} SELECT a.topic AS topic_a, b.topic AS topic_b, round(list_cosine_similarity(a.vec, b.vec), 6) AS cosine
    FROM cent a JOIN cent b ON a.topic < b.topic""",
)
def _(spark, sf):
    return topics.topic_similarity(_centres(spark, sf))


@query(
    "topic_info",
    f"""WITH {CENTRES}, tok AS (SELECT label AS topic, unnest({v.sql_letter_tokens('text')}) AS w FROM documents JOIN embeddings ON doc_id = vec_id),
    r AS (SELECT topic, w, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, w) AS rk FROM tok GROUP BY 1, 2),
    rep AS (SELECT topic, string_agg(w, ', ' ORDER BY rk) AS representation FROM r WHERE rk <= 10 GROUP BY 1),
    s AS (SELECT label AS topic, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], vec), 9) AS sim FROM embeddings JOIN cent ON topic = label),
    n AS (SELECT topic, vec_id, row_number() OVER (PARTITION BY topic ORDER BY sim DESC, vec_id) AS rk FROM s),
    near AS (SELECT topic, string_agg(CAST(vec_id AS VARCHAR), ', ' ORDER BY rk) AS representative FROM n WHERE rk <= 3 GROUP BY 1)
    SELECT label AS topic, count(*) AS n, any_value(representation) AS representation, any_value(representative) AS representative
    FROM embeddings LEFT JOIN rep ON rep.topic = label LEFT JOIN near ON near.topic = label GROUP BY label""",
)
def _(spark, sf):
    emb = v.embeddings(spark, sf)
    docs = v.reviews(spark, sf).join(emb, F.col("comment_id") == F.col("vec_id"))
    words = explode_rows(docs, _phrase_tokens("commentaire"), "term", F.col("label").alias("topic"))
    weights = words.groupBy("topic", "term").agg(F.count("*").alias("weight"))
    top = topics.topic_top_words(weights, 10).withColumnRenamed("term", "word")
    info = topics.topic_info(emb, top, "vec_id", "label")
    return info.withColumns({"representation": F.array_join("representation", ", "), "representative": F.array_join(F.col("representative").cast("array<string>"), ", ")})


@query("cluster_embeddings", "SELECT vec_id, true AS in_range FROM embeddings")
def _(spark, sf):
    rows = v.embeddings(spark, sf).select("vec_id", "embedding")
    found = topics.cluster_embeddings(rows, [8, 10, 12])
    return found.select("vec_id", F.col("topics").between(0, 11).alias("in_range"))


@query(
    "split_large_clusters",
    """WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT vec_id, CASE WHEN n > 50 THEN -1 ELSE CAST(label AS INT) END AS kept_topic,
      n > 50 AS renamed FROM embeddings JOIN n USING (label)""",
)
def _(spark, sf):
    rows = v.embeddings(spark, sf).select("vec_id", F.col("label").cast("int").alias("topics"), "embedding")
    last = rows.agg(F.max("topics")).scalar()
    found = subclusters.split_large_clusters(rows, above=50, per_cluster=20).withColumn("renamed", F.col("topics") > last)
    return found.select("vec_id", F.when(F.col("renamed"), -1).otherwise(F.col("topics")).alias("kept_topic"), "renamed")


# One row a merge: the clusters left, and the pair that went into one.
MERGES = """WITH RECURSIVE rows AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label <> -1 AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  lengths AS (SELECT label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM rows),
  units AS (SELECT label, generate_subscripts(e, 1) AS d, unnest(e) / CASE WHEN l = 0 THEN 1 ELSE l END AS x FROM lengths),
  cells AS (SELECT CAST(label AS BIGINT) AS id, d, count(*) AS n, sum(x) / count(*) AS m FROM units GROUP BY 1, 2),
  means AS (SELECT id, max(n) AS n, list(m ORDER BY d) AS m FROM cells GROUP BY id),
  merges AS (SELECT list({'id': id, 'n': n, 'm': m}) AS left_over, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS similarity, NULL::BIGINT AS n FROM means
    UNION ALL SELECT list_append(list_filter(left_over, lambda c: c.id <> p.x.id AND c.id <> p.y.id), {'id': p.x.id, 'n': p.x.n + p.y.n,
        'm': list_transform(list_zip(p.x.m, p.y.m), lambda z: (z[1] * p.x.n + z[2] * p.y.n) / (p.x.n + p.y.n))}),
      p.x.id, p.y.id, p.s, p.x.n + p.y.n
    FROM (SELECT left_over, (SELECT {'x': x, 'y': y, 's': round(list_dot_product(x.m, y.m), 12)} FROM (SELECT unnest(left_over) AS x), (SELECT unnest(left_over) AS y)
      WHERE x.id < y.id ORDER BY round(list_dot_product(x.m, y.m), 12) DESC, x.id, y.id LIMIT 1) AS p FROM merges WHERE len(left_over) > 1))
  SELECT a, b, round(similarity, 9) AS similarity, n FROM merges WHERE a IS NOT NULL"""


@query("topic_merges", MERGES)
def _(spark, sf):
    rows = v.embeddings(spark, sf).select("vec_id", F.col("label").cast("int").alias("topics"), "embedding")
    return linkage.merge_table(linkage.topic_means(rows)).select("a", "b", F.round("similarity", 9).alias("similarity"), "n")


EPS, CORE, SIZE = 1.18, 4, 5


@query(
    "density_clusters",
    f"""WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    nb AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b WHERE list_distance(a.v, b.v) <= {EPS}),
    core AS MATERIALIZED (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {CORE}),
    ce AS MATERIALIZED (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS r FROM core UNION SELECT ce.b, reach.r FROM reach JOIN ce ON ce.a = reach.id WHERE reach.r <= ce.b),
    comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
    bord AS (SELECT a AS id, min(b) AS b FROM nb WHERE a NOT IN (SELECT id FROM core) AND b IN (SELECT id FROM core) GROUP BY a),
    mem AS (SELECT id, c FROM comp UNION ALL SELECT bord.id, c FROM bord JOIN comp ON comp.id = bord.b),
    big AS (SELECT c FROM mem GROUP BY c HAVING count(*) >= {SIZE})
    SELECT vec_id, CAST(coalesce(c, -1) AS BIGINT) AS cluster FROM e LEFT JOIN (SELECT * FROM mem WHERE c IN (SELECT c FROM big)) m ON m.id = vec_id""",
)
def _(spark, sf):
    return density.density_clusters(v.embeddings(spark, sf), "vec_id", "embedding", EPS, CORE, SIZE)


# --- topic models -------------------------------------------------------------------------------------------------


def _lda(spark, sf):
    rows = v.token_reviews(spark, sf).select("comment_id", "clean_tokens").cache()
    vectoriser = topics.tfidf_model(rows, "clean_tokens", min_df=5, max_df=0.95)
    weighted = vectoriser.transform(rows)
    return vectoriser, weighted, topics.lda_fit(weighted, k=20)


@query(
    "lda_fit",
    """SELECT CAST(t AS INT) AS topic, CAST(r AS INT) AS rank, true AS known_term FROM generate_series(0, 19) a(t), generate_series(1, 20) b(r)""",
)
def _(spark, sf):
    vectoriser, weighted, model = _lda(spark, sf)
    words = topics.lda_topic_words(model, topics.vocabulary_of(vectoriser), 20)
    seen = explode_rows(weighted, F.array_distinct("clean_tokens"), "term").groupBy("term").agg(F.count("*").alias("df"))
    limits = seen.filter((F.col("df") >= 5) & (F.col("df") <= 0.95 * weighted.count()))
    return words.join(limits, "term", "left").select("topic", "rank", F.col("df").isNotNull().alias("known_term"))


@query("lda_dominant_topic", "SELECT doc_id AS comment_id, true AS in_range FROM documents")
def _(spark, sf):
    _, weighted, model = _lda(spark, sf)
    found = topics.dominant_topic(topics.topic_distribution(model, weighted, "comment_id"))
    return found.select("comment_id", (F.col("topic_id").between(0, 19) & F.col("topic_confidence").between(0, 1)).alias("in_range"))


# --- quality ------------------------------------------------------------------------------------------------------


@query(
    "topic_diversity",
    f"""{TW(20)} SELECT count(DISTINCT word) AS distinct_words, count(word) AS words, round(count(DISTINCT word) / count(word), 6) AS diversity
    FROM tw WHERE topic <> -1 AND rank <= 10""",
)
def _(spark, sf):
    return quality.topic_diversity(phrase_topic_words(spark, sf, 20), 10)


DOCW = f"""{TW(10)}, tws AS (SELECT topic, rank, word FROM tw WHERE topic <> -1),
  dtok AS MATERIALIZED (SELECT comment_id, {v.sql_letter_tokens('commentaire')} AS t FROM reviews)"""
UMASS = f"""{DOCW}, dw AS MATERIALIZED (SELECT DISTINCT comment_id, w FROM (SELECT comment_id, unnest(t) AS w FROM dtok) WHERE w IN (SELECT word FROM tws)),
  nd AS (SELECT count(*)::DOUBLE AS n FROM dtok), d1 AS (SELECT w, count(*) AS c FROM dw GROUP BY w),
  d2 AS (SELECT a.w AS wa, b.w AS wb, count(*) AS c FROM dw a JOIN dw b USING (comment_id) GROUP BY 1, 2),
  m AS (SELECT x.topic, ln((coalesce(d2.c, 0) / n + 1e-12::DOUBLE) / (d1.c / n)) AS s FROM nd, tws x JOIN tws y ON x.topic = y.topic AND y.rank < x.rank
    JOIN d1 ON d1.w = y.word JOIN d1 dx ON dx.w = x.word LEFT JOIN d2 ON wa = x.word AND wb = y.word),
  u AS (SELECT topic, avg(s) AS score FROM m GROUP BY topic)"""


@query("coherence_umass", f"{UMASS} SELECT round(avg(score), 6) AS score FROM u")
def _(spark, sf):
    docs = v.token_reviews(spark, sf)
    return quality.coherence_umass(phrase_topic_words(spark, sf, 10), docs, F.col("clean_tokens"))


@query("coherence_umass_per_topic", f"{UMASS} SELECT topic, round(score, 6) AS score FROM u")
def _(spark, sf):
    docs = v.token_reviews(spark, sf)
    return quality.coherence_umass(phrase_topic_words(spark, sf, 10), docs, F.col("clean_tokens"), per_topic=True)


def _cv_sql(per_topic: bool) -> str:
    total = (
        "(SELECT topic, sum(s + 1) AS tot FROM (SELECT DISTINCT topic, comment_id, s FROM occ JOIN tws ON word = w) GROUP BY topic)"
        if per_topic
        else "(SELECT topic, tot FROM (SELECT DISTINCT topic FROM tws), (SELECT sum(s + 1) AS tot FROM (SELECT DISTINCT comment_id, s FROM occ)))"
    )
    return f"""{DOCW}, dl AS (SELECT comment_id, t, greatest(len(t) - 110, 0) AS s FROM dtok),
    occ AS MATERIALIZED (SELECT * FROM (SELECT comment_id, s, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS p FROM dl) WHERE w IN (SELECT word FROM tws)),
    win AS MATERIALIZED (SELECT DISTINCT comment_id, w, unnest(generate_series(greatest(p - 109, 0), least(p, s))) AS st FROM occ),
    w1 AS (SELECT w, count(*)::DOUBLE AS c FROM win GROUP BY w),
    prs AS (SELECT DISTINCT x.word AS wa, y.word AS wb FROM tws x JOIN tws y USING (topic)),
    w2 AS MATERIALIZED (SELECT wa, wb, count(*)::DOUBLE AS c FROM win a JOIN win b ON a.comment_id = b.comment_id AND a.st = b.st JOIN prs ON wa = a.w AND wb = b.w GROUP BY 1, 2),
    tot AS {total},
    v AS (SELECT x.topic, x.word AS wa, y.word AS wb, ln((coalesce(w2.c, 0) / tot + 1e-12::DOUBLE) / ((ca.c / tot) * (cb.c / tot))) / -ln(coalesce(w2.c, 0) / tot + 1e-12::DOUBLE) AS v
      FROM tws x JOIN tws y USING (topic) JOIN tot USING (topic) JOIN w1 ca ON ca.w = x.word JOIN w1 cb ON cb.w = y.word LEFT JOIN w2 ON wa = x.word AND wb = y.word),
    st AS (SELECT topic, wb, sum(v) AS s FROM v GROUP BY 1, 2),
    co AS (SELECT topic, wa, sum(v * s) / sqrt(sum(v * v) * sum(s * s)) AS c FROM v JOIN st USING (topic, wb) GROUP BY 1, 2),
    cv AS (SELECT topic, avg(c) AS score FROM co GROUP BY topic)"""


@query("coherence_cv", f"{_cv_sql(False)} SELECT round(avg(score), 6) AS score FROM cv")
def _(spark, sf):
    docs = v.token_reviews(spark, sf)
    return quality.coherence_cv(phrase_topic_words(spark, sf, 10), docs, F.col("clean_tokens"), 10)


@query("coherence_cv_per_topic", f"{_cv_sql(True)} SELECT topic, round(score, 6) AS score FROM cv")
def _(spark, sf):
    docs = v.token_reviews(spark, sf)
    return quality.coherence_cv(phrase_topic_words(spark, sf, 10), docs, F.col("clean_tokens"), 10, per_topic=True)


# Topic words with known vectors: the words of the corpus, ranked by topic of their document.
SHORT = f"""{W}, {VOCAB_SQL}, sw AS (SELECT CAST(comment_id % 5 AS INT) AS topic, term, count(*) AS n FROM tw_tok GROUP BY 1, 2),
  tw AS (SELECT topic, term AS word, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS rk FROM sw) WHERE rk <= 10)"""


def _corpus_topic_words(spark, sf):
    group = (F.col("comment_id") % 5).cast("int").alias("topic")
    rows = explode_rows(v.reviews(spark, sf), tx.analyzer_tokens("commentaire"), "term", group)
    counts = rows.groupBy("topic", "term").agg(F.count("*").alias("weight"))
    return topics.topic_top_words(counts, 10).withColumnRenamed("term", "word")


EMB = f"""{SHORT}, pr AS (SELECT a.topic, avg(list_cosine_similarity(x.vector::DOUBLE[], y.vector::DOUBLE[])) AS s FROM tw a JOIN tw b ON a.topic = b.topic AND a.word <> b.word
  JOIN wv x ON x.term = a.word JOIN wv y ON y.term = b.word GROUP BY 1)"""


@query("coherence_embedding", f"{EMB} SELECT round(avg(s), 6) AS score FROM pr")
def _(spark, sf):
    return quality.coherence_embedding(_corpus_topic_words(spark, sf), word_vecs(spark, sf))


@query(
    "topic_model_comparison",
    f"""{EMB.replace('WITH ', 'WITH ', 1)}, {v.SENTENCES[len(v.REVIEWS) + 2:]}, phrases AS (SELECT *, CAST((comment_id * 7 + sent_no) % 12 - 1 AS INT) AS topics FROM sentences),
    {TOPIC_WORDS.format(tok=v.sql_letter_tokens('sentence'), n=10).replace('tw AS', 'ptw AS')}, ptws AS (SELECT * FROM ptw WHERE topic <> -1),
    {UMASS[UMASS.index('dtok AS'):].replace('tws', 'ptws')}
    SELECT 'phrases' AS model, round(count(DISTINCT word) / count(word), 6) AS diversity, (SELECT round(avg(score), 6) FROM u) AS coherence FROM ptws
    UNION ALL SELECT 'corpus words', round(count(DISTINCT word) / count(word), 6), (SELECT round(avg(s), 6) FROM pr) FROM tw""",
)
def _(spark, sf):
    short, phrases = store(_corpus_topic_words(spark, sf), "corpus-words"), store(phrase_topic_words(spark, sf, 10), "phrase-words")
    return quality.topic_model_comparison(
        {
            "phrases": (
                quality.topic_diversity(phrases),
                quality.coherence_umass(phrases, v.token_reviews(spark, sf), F.col("clean_tokens")),
            ),
            "corpus words": (
                quality.topic_diversity(short),
                quality.coherence_embedding(short, word_vecs(spark, sf)),
            ),
        }
    )

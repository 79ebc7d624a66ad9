"""Queries over profiling, time series and relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text as tx
from ..operators import profile, quantiles, relational, timeseries
from ..sources import readers, writers
from . import views as v
from .q_clean import SQL_LETTERS, detected, PROFILE
from .registry import query

W = "WITH " + v.REVIEWS
LEN = "CAST(length(coalesce(commentaire, '')) AS INT)"

_cols = [("comment_id", "bigint"), ("commentaire", "string"), ("star", "int"), ("review_date", "date"), ("client", "string"), ("reponse", "string"), ("company", "string"), ("lang", "string")]


@query(
    "table_profile",
    W + " UNION ALL ".join(
        f""" SELECT '{c}' AS "column", '{t}' AS type, count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls,
        round(100::DOUBLE * (count(*) - count({c})) / count(*), 6) AS null_pct FROM reviews"""
        for c, t in _cols
    ),
)
def _(spark, sf):
    return profile.table_profile(v.reviews(spark, sf))


@query(
    "describe_numeric",
    f"""{W}, l AS (SELECT star, {LEN} AS chars FROM reviews)
    SELECT star, count(*) AS count, round(avg(chars), 6) AS mean, round(stddev_samp(chars), 6) AS std, min(chars)::DOUBLE AS min,
      max(chars)::DOUBLE AS max, round(quantile_cont(chars, 0.25), 6) AS q1, round(quantile_cont(chars, 0.5), 6) AS median,
      round(quantile_cont(chars, 0.75), 6) AS q3 FROM l GROUP BY star""",
)
def _(spark, sf):
    rows = v.reviews(spark, sf).select("star", tx.char_length("commentaire").alias("chars"))
    return profile.describe_numeric(rows, "chars", ["star"])


@query(
    "describe_prices",
    """SELECT o_orderpriority, count(o_totalprice) AS count, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std,
      min(o_totalprice)::DOUBLE AS min, max(o_totalprice)::DOUBLE AS max, round(quantile_cont(o_totalprice::DOUBLE, 0.25), 6) AS q1,
      round(quantile_cont(o_totalprice::DOUBLE, 0.5), 6) AS median, round(quantile_cont(o_totalprice::DOUBLE, 0.75), 6) AS q3
    FROM orders GROUP BY o_orderpriority""",
)
def _(spark, sf):
    return profile.describe_numeric(v.table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])


@query(
    "quantiles_price",
    """SELECT count(l_extendedprice) AS n, quantile_cont(l_extendedprice::DOUBLE, 0.5) AS p50, quantile_cont(l_extendedprice::DOUBLE, 0.9) AS p90,
      quantile_cont(l_extendedprice::DOUBLE, 0.999) AS p999 FROM lineitem""",
)
def _(spark, sf):
    return quantiles.exact_quantiles(v.table(spark, sf, "lineitem"), "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p999": 0.999})


@query("value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return profile.value_counts(v.table(spark, sf, "orders"), "o_orderpriority")


@query(
    "value_share",
    "SELECT event_type, count(*) AS n, round(100::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY 1",
)
def _(spark, sf):
    return profile.value_share(v.table(spark, sf, "events"), "event_type")


BLANKED = f"""{W}, b AS (SELECT star, CASE WHEN comment_id % 7 = 0 THEN ' ' ELSE commentaire END AS commentaire FROM reviews),
  c AS (SELECT star, {v.sql_strip('commentaire')} NOT IN ('', 'nan', 'NaT') AS has FROM b)"""


def _blanked(spark, sf):
    spoiled = F.when(F.col("comment_id") % 7 == 0, " ").otherwise(F.col("commentaire"))
    return v.reviews(spark, sf).withColumn("commentaire", spoiled)


@query("comment_rate_by_star", f"{BLANKED} SELECT star, round(100 * avg(CAST(has AS DOUBLE)), 6) AS comment_pct FROM c GROUP BY star")
def _(spark, sf):
    return profile.comment_rate_by_star(_blanked(spark, sf))


@query("comment_presence_by_star", f"{BLANKED} SELECT star, CAST(has AS INT) AS has_comment, count(*) AS n FROM c GROUP BY 1, 2")
def _(spark, sf):
    return profile.comment_presence_by_star(_blanked(spark, sf))


@query("response_rate_by_star", f"{W} SELECT star, round(avg(CASE WHEN reponse IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS response_rate FROM reviews GROUP BY star")
def _(spark, sf):
    return profile.response_rate_by_star(v.reviews(spark, sf))


WITH_WITHOUT = "count(*) FILTER (reponse IS NULL) AS without_response, count(*) FILTER (reponse IS NOT NULL) AS with_response"


@query("response_counts_by_star", f"{W} SELECT star, {WITH_WITHOUT} FROM reviews GROUP BY star")
def _(spark, sf):
    return profile.response_counts_by_star(v.reviews(spark, sf))


BINS = f"""{W}, edges AS (SELECT * FROM (VALUES (-1, 50, '<50'), (50, 100, '50-100'), (100, 200, '100-200'), (200, 500, '200-500'),
  (500, 1000, '500-1000'), (1000, 2000, '1000-2000'), (2000, 2000000000, '2000+')) e(lo, hi, length_bin)),
  l AS (SELECT comment_id, reponse, {LEN} AS chars FROM reviews)"""


@query("length_bin", f"{BINS} SELECT comment_id, length_bin FROM l JOIN edges ON chars > lo AND chars <= hi")
def _(spark, sf):
    rows = v.reviews(spark, sf).select("comment_id", profile.length_bin(tx.char_length("commentaire")).alias("b"))
    return rows.select("comment_id", profile.length_bin_name(F.col("b")).alias("length_bin"))


@query(
    "response_rate_by_length",
    f"""{BINS} SELECT length_bin, round(avg(CASE WHEN comment_id IS NULL THEN NULL WHEN reponse IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS response_rate
    FROM edges LEFT JOIN l ON chars > lo AND chars <= hi GROUP BY length_bin""",
)
def _(spark, sf):
    return profile.response_rate_by_length(v.reviews(spark, sf))


@query(
    "response_counts_by_length",
    f"""{BINS} SELECT length_bin, count(*) FILTER (comment_id IS NOT NULL AND reponse IS NULL) AS without_response,
    count(reponse) AS with_response FROM edges LEFT JOIN l ON chars > lo AND chars <= hi GROUP BY length_bin""",
)
def _(spark, sf):
    return profile.response_counts_by_length(v.reviews(spark, sf))


CLEANED = f"{W}, c AS (SELECT star, comment_id, {SQL_LETTERS} AS t FROM reviews), w AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words FROM c)"


@query(
    "text_length_stats",
    f"{CLEANED} SELECT count(*) FILTER (t <> '') AS non_empty, round(avg(words), 6) AS mean_words, round(avg(length(t)), 6) AS mean_chars FROM w",
)
def _(spark, sf):
    return profile.text_length_stats(v.reviews(spark, sf), tx.clean_letters_stop("commentaire", v.STOPS))


@query(
    "length_histogram",
    f"""{CLEANED}, m AS (SELECT min(words) AS lo, max(words) AS hi FROM w),
    h AS (SELECT least(49, CAST(floor((words - lo) * 50::DOUBLE / (hi - lo)) AS INT)) AS bin, count(*) AS n FROM w, m GROUP BY 1)
    SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * ((hi - lo) / 50::DOUBLE), 6) AS lower_edge, coalesce(n, 0) AS n
    FROM generate_series(0, 49) g(bin) CROSS JOIN m LEFT JOIN h ON h.bin = g.bin""",
)
def _(spark, sf):
    words = tx.word_count_simple(tx.clean_letters_stop("commentaire", v.STOPS))
    return profile.length_histogram(v.reviews(spark, sf).select(words.alias("words")), "words")


@query(
    "length_by_star",
    f"""{W}, l AS (SELECT star, CAST(length(commentaire) AS INT) AS chars FROM reviews)
    SELECT star, count(*) AS n, min(chars) AS min_chars, round(quantile_cont(chars, 0.25), 6) AS q1, round(quantile_cont(chars, 0.5), 6) AS median,
      round(quantile_cont(chars, 0.75), 6) AS q3, max(chars) AS max_chars FROM l GROUP BY star""",
)
def _(spark, sf):
    return profile.length_by_star(v.reviews(spark, sf))


ORDER_DAYS = "d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)"


def _order_days(spark, sf):
    return timeseries.daily_counts(v.table(spark, sf, "orders"), "o_orderdate")


def _box_sql(group: str) -> str:
    g, on = (f"{group},", f"USING ({group})") if group else ("", "ON true")
    by = f"GROUP BY {group}" if group else ""
    by2 = f"GROUP BY {g} q1, median, q3"
    return f"""q AS (SELECT {g} quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3 FROM r {by})
    SELECT {g} q1, median, q3, min(CASE WHEN inside THEN n END)::DOUBLE AS whisker_low, max(CASE WHEN inside THEN n END)::DOUBLE AS whisker_high,
      count(*) FILTER (NOT inside) AS outliers
    FROM (SELECT r.*, q1, median, q3, n BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM r JOIN q {on}) {by2}"""


@query("box_stats", f"WITH {ORDER_DAYS}, r AS (SELECT n FROM d), {_box_sql('')}")
def _(spark, sf):
    return profile.box_stats(_order_days(spark, sf), "n")


@query("box_stats_by_month", f"WITH {ORDER_DAYS}, r AS (SELECT CAST(month(day) AS INT) AS month, n FROM d), {_box_sql('month')}")
def _(spark, sf):
    return profile.box_stats(_order_days(spark, sf).withColumn("month", F.month("day")), "n", ["month"])


@query("term_rate_by_star", f"{CLEANED} SELECT star, round(100 * avg(CASE WHEN contains(t, 'tion') THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct FROM w GROUP BY star")
def _(spark, sf):
    rows = v.reviews(spark, sf).select("star", tx.clean_letters_stop("commentaire", v.STOPS).alias("comment_clean"))
    return profile.term_rate_by_star(rows, "tion")


@query("company_counts", f"{W} SELECT company, count(*) AS n, round(100::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM reviews GROUP BY 1")
def _(spark, sf):
    return profile.company_counts(v.reviews(spark, sf))


@query("mean_star_by_company", f"{W} SELECT company, round(avg(star), 6) AS mean_star FROM reviews GROUP BY 1")
def _(spark, sf):
    return profile.mean_star_by_company(v.reviews(spark, sf))


@query("rating_matrix", f"{W} SELECT company, {', '.join(f'count(*) FILTER (star = {s}) AS star_{s}' for s in range(1, 6))} FROM reviews GROUP BY 1")
def _(spark, sf):
    return profile.rating_matrix(v.reviews(spark, sf))


@query("star_distribution", f"{W} SELECT star, count(*) AS n FROM reviews GROUP BY ROLLUP (star)")
def _(spark, sf):
    return profile.star_distribution(v.reviews(spark, sf))


@query("lang_distribution", f"{W}, {PROFILE} SELECT lang_detected, count(*) AS n FROM det WHERE lang_detected IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return profile.lang_distribution(detected(spark, sf), "lang_detected")


@query("lang_fr_vs_other", f"{W}, {PROFILE} SELECT CASE WHEN lang_detected = 'fr' THEN 'fr' ELSE 'Autres' END AS lang_group, count(*) AS n FROM det GROUP BY 1")
def _(spark, sf):
    return profile.lang_fr_vs_other(detected(spark, sf), "lang_detected")


@query("lang_non_fr", f"{W} SELECT lang, count(*) AS n FROM reviews WHERE lang <> 'fr' GROUP BY 1")
def _(spark, sf):
    return profile.lang_non_fr(v.reviews(spark, sf))


# --- dates -----------------------------------------------------------------------------------------------------

DATE_TEXT_SQL = """CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S+00:00') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN ' nan ' ELSE 'le ' || strftime(o_orderdate, '%Y-%m-%d') END"""
DATE_TEXT = f"WITH o AS (SELECT o_orderkey, {DATE_TEXT_SQL} AS date FROM orders)"


def _date_texts(spark, sf):
    day, which = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(which == 0, F.concat(F.date_format(day, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")))
        .when(which == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(which == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(which == 3, F.lit(" nan "))
        .otherwise(F.concat(F.lit("le "), F.date_format(day, "yyyy-MM-dd")))
    )
    return v.table(spark, sf, "orders").select("o_orderkey", text.alias("date"))


@query(
    "normalize_date",
    f"""{DATE_TEXT} SELECT o_orderkey, CAST(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%d-%m-%Y')) AS DATE) AS day
    FROM (SELECT o_orderkey, split_part(split_part(replace(trim(date), '/', '-'), '+', 1), ' ', 1) AS d FROM o)""",
)
def _(spark, sf):
    return _date_texts(spark, sf).select("o_orderkey", dates.normalize_date("date").alias("day"))


@query(
    "date_parts_text",
    f"""{DATE_TEXT}, p AS (SELECT o_orderkey, string_split(split_part(date, ' ', 1), '-') AS x FROM o),
    c AS (SELECT o_orderkey, TRY_CAST(x[1] AS INT) AS year, TRY_CAST(x[2] AS INT) AS month, TRY_CAST(x[3] AS INT) AS day FROM p)
    SELECT o_orderkey, CASE WHEN ok THEN day END AS day, CASE WHEN ok THEN month END AS month, CASE WHEN ok THEN year END AS year
    FROM (SELECT *, year IS NOT NULL AND month IS NOT NULL AND day IS NOT NULL AS ok FROM c)""",
)
def _(spark, sf):
    return _date_texts(spark, sf).select("o_orderkey", dates.date_parts_text("date").alias("p")).select("o_orderkey", "p.*")


SEASON = """CASE WHEN m IN (12, 1, 2) THEN 'Hiver' WHEN m IN (3, 4, 5) THEN 'Printemps' WHEN m IN (6, 7, 8) THEN 'Été' WHEN m IN (9, 10, 11) THEN 'Automne' END"""
PARTS = f"""{W}, p AS (SELECT comment_id, commentaire, review_date, CAST(day(review_date) AS INT) AS d, CAST(month(review_date) AS INT) AS m,
  CAST(year(review_date) AS INT) AS y FROM reviews), s AS (SELECT *, {SEASON} AS season FROM p)"""


@query("date_parts", f"{PARTS} SELECT comment_id, d AS day, m AS month, y AS year FROM s")
def _(spark, sf):
    return v.reviews(spark, sf).select("comment_id", dates.date_parts("review_date").alias("p")).select("comment_id", "p.*")


@query("season", f"{PARTS} SELECT comment_id, season FROM s")
def _(spark, sf):
    return v.reviews(spark, sf).select("comment_id", dates.season(F.month("review_date")).alias("season"))


@query("quarter_label", f"{PARTS} SELECT comment_id, CAST(y AS VARCHAR) || 'Q' || CAST(quarter(review_date) AS VARCHAR) AS quarter FROM s")
def _(spark, sf):
    return v.reviews(spark, sf).select("comment_id", dates.quarter_label("review_date").alias("quarter"))


@query(
    "date_completeness",
    PARTS + " SELECT count(*) AS total, " + ", ".join(f"count({c}) AS {n}_filled, round(100::DOUBLE * count({c}) / count(*), 6) AS {n}_pct" for c, n in (("d", "day"), ("m", "month"), ("y", "year"), ("season", "season"))) + ", min(y) AS min_year, max(y) AS max_year FROM s",
)
def _(spark, sf):
    return timeseries.date_completeness(v.reviews(spark, sf))


@query("count_by_year_season", f"{PARTS} SELECT y AS year, season, count(commentaire) AS n FROM s WHERE y IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return timeseries.count_by_year_season(v.reviews(spark, sf))


@query("daily_counts", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return timeseries.daily_counts(v.table(spark, sf, "events"), "ts")


@query("peak_day", f"WITH {ORDER_DAYS} SELECT day, n FROM d ORDER BY n DESC, day LIMIT 1")
def _(spark, sf):
    return timeseries.peak_day(_order_days(spark, sf))


MONTHS = f"{W}, m AS (SELECT CAST(date_trunc('month', review_date) AS DATE) AS month, count(commentaire) AS n FROM reviews WHERE review_date IS NOT NULL GROUP BY 1)"


@query("monthly_counts", f"{MONTHS} SELECT month, n FROM m")
def _(spark, sf):
    return timeseries.monthly_counts(v.reviews(spark, sf))


@query("top_months", f"{MONTHS} SELECT month, n FROM m ORDER BY n DESC, month LIMIT 5")
def _(spark, sf):
    return timeseries.top_months(timeseries.monthly_counts(v.reviews(spark, sf)))


@query(
    "daily_outliers",
    f"""WITH {ORDER_DAYS}, s AS (SELECT avg(n) AS m, stddev_samp(n) AS sd FROM d)
    SELECT day, n, round((n - m) / sd, 6) AS z_score FROM d, s WHERE (n - m) / sd > 2""",
)
def _(spark, sf):
    return timeseries.daily_outliers(_order_days(spark, sf), 2.0)


@query(
    "daily_describe",
    f"""WITH {ORDER_DAYS} SELECT count(*) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n)::DOUBLE AS min,
      max(n)::DOUBLE AS max, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q3 FROM d""",
)
def _(spark, sf):
    return timeseries.daily_describe(_order_days(spark, sf))


@query("total_of_daily", f"WITH {ORDER_DAYS} SELECT CAST(sum(n) AS BIGINT) AS total FROM d")
def _(spark, sf):
    return timeseries.total_of_daily(_order_days(spark, sf))


@query(
    "order_gap_days",
    """SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS ecart
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(spark, sf):
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = lines.join(orders, "l_orderkey")
    return joined.select("l_orderkey", "l_linenumber", dates.order_gap_days("l_shipdate", "o_orderdate").alias("ecart"))


# --- joins, samples, top-k ---------------------------------------------------------------------------------------

CATS = f"WITH {v.PHRASES}, {v.SHEET}, pc AS (SELECT p.*, cat FROM phrases p LEFT JOIN sheet ON p.topics = sheet.Topic)"
KEEP = ["comment_id", "sent_no", "topics"]


def categorised(spark, sf):
    return relational.join_topic_category(v.phrase_topics(spark, sf), v.topic_sheet(spark))


@query("join_topic_category", f'{CATS} SELECT comment_id, sent_no, topics, cat AS "Catégorie" FROM pc')
def _(spark, sf):
    return categorised(spark, sf).select(*KEEP, "Catégorie")


@query("map_topic_category", f"{CATS} SELECT comment_id, sent_no, topics, cat AS categorie_detectee FROM pc")
def _(spark, sf):
    return relational.map_topic_category(v.phrase_topics(spark, sf), v.TOPIC_CATEGORIES).select(*KEEP, "categorie_detectee")


KNOWN = ["qualité produit", "Service livraison", "mixte"]


@query("filter_known_categories", f"""{CATS} SELECT comment_id, sent_no, cat AS "Catégorie" FROM pc WHERE cat IN ({v.lit(KNOWN)})""")
def _(spark, sf):
    return relational.filter_known_categories(categorised(spark, sf), KNOWN).select("comment_id", "sent_no", "Catégorie")


H = v.sql_hash("CAST(doc_id AS VARCHAR) || ':42'")


def _label_rows(spark, sf):
    return v.table(spark, sf, "labels").select("doc_id", "quality", "toxic")


@query(
    "concat_samples",
    f"""(SELECT doc_id, 'quality' AS label FROM labels WHERE quality = 1 ORDER BY {H}, doc_id LIMIT 20)
    UNION ALL (SELECT doc_id, 'toxic' AS label FROM labels WHERE toxic = 1 ORDER BY {H}, doc_id LIMIT 20)""",
)
def _(spark, sf):
    rows = _label_rows(spark, sf)
    parts = {c: relational.sample_n(rows.filter(F.col(c) == 1), 20, "doc_id").select("doc_id") for c in v.SCORE_LABELS}
    return relational.concat_samples(parts)


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    return relational.top_k(v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10)


@query("head_rows", f"{W} SELECT comment_id, star, commentaire FROM reviews ORDER BY comment_id LIMIT 5")
def _(spark, sf):
    return relational.head_rows(v.reviews(spark, sf), 5, "comment_id").select("comment_id", "star", "commentaire")


@query(
    "head_per_group",
    f"""WITH {v.PHRASES} SELECT topics, comment_id, sent_no, sentence FROM
    (SELECT *, row_number() OVER (PARTITION BY topics ORDER BY comment_id, sent_no) AS rn FROM phrases) WHERE rn <= 5""",
)
def _(spark, sf):
    rows = v.phrase_topics(spark, sf).select("topics", "comment_id", "sent_no", "sentence")
    return relational.head_per_group(rows, "topics", ["comment_id", "sent_no"], 5)


@query("sample_n", f"SELECT doc_id, source FROM documents ORDER BY {H}, doc_id LIMIT 100")
def _(spark, sf):
    return relational.sample_n(v.table(spark, sf, "documents").select("doc_id", "source"), 100, "doc_id")


@query(
    "sample_per_label",
    f"""WITH l AS (SELECT doc_id, 'quality' AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)
    SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}, doc_id) AS rn FROM l) WHERE rn <= 30""",
)
def _(spark, sf):
    return relational.sample_per_label(_label_rows(spark, sf), v.SCORE_LABELS, 30, "doc_id").select("doc_id", "label")


@query("distinct_values", f"{W} SELECT DISTINCT company FROM reviews")
def _(spark, sf):
    return relational.distinct_values(v.reviews(spark, sf), "company")


@query(
    "review_lookup",
    f"""{CATS} SELECT comment_id, any_value(commentaire) AS commentaire, string_agg(sentence, '|' ORDER BY sent_no) AS sentences,
      coalesce(array_to_string(list_sort(list(DISTINCT cat) FILTER (cat IS NOT NULL)), '|'), '') AS categories,
      coalesce(array_to_string(list_sort(list(DISTINCT cat) FILTER (cat IN ({v.lit(KNOWN)}))), '|'), '') AS final_labels
    FROM pc WHERE comment_id = 14 GROUP BY comment_id""",
)
def _(spark, sf):
    found = relational.review_lookup(categorised(spark, sf), 14, KNOWN)
    return found.withColumns({c: F.array_join(c, "|") for c in ("sentences", "categories", "final_labels")})


TOPIC_WORDS = """tw AS (SELECT lbl AS topic, rk AS rank, w AS word FROM (
  SELECT topics AS lbl, w, row_number() OVER (PARTITION BY topics ORDER BY count(*) DESC, w) AS rk
  FROM (SELECT topics, unnest({tok}) AS w FROM phrases) GROUP BY topics, w) WHERE rk <= {n})"""


@query(
    "topic_lookup",
    f"""{CATS}, {TOPIC_WORDS.format(tok=v.sql_letter_tokens('sentence'), n=10)}
    SELECT topics AS topic, (SELECT string_agg(word, ', ' ORDER BY rank) FROM tw WHERE topic = 4) AS words, cat AS category,
      CASE WHEN cat IN ({v.lit(KNOWN)}) THEN cat END AS final_label, comment_id, sent_no, sentence, star
    FROM pc WHERE topics = 4 ORDER BY comment_id, sent_no LIMIT 50""",
)
def _(spark, sf):
    from .q_topics import phrase_topic_words

    return relational.topic_lookup(categorised(spark, sf), phrase_topic_words(spark, sf, 10), 4, 50, KNOWN)


@query("read_topic_words", "SELECT CAST(label AS INT) AS topic, CAST(p AS INT) AS rank, trim(string_split(w, ',')[p]) AS word FROM (SELECT label, string_agg(DISTINCT CAST(vec_id % 7 AS VARCHAR), ', ' ORDER BY CAST(vec_id % 7 AS VARCHAR)) AS w FROM embeddings GROUP BY label), generate_series(1, 7) g(p) WHERE p <= len(string_split(w, ','))")
def _(spark, sf):
    packed = v.embeddings(spark, sf).groupBy("label").agg(
        F.array_join(F.sort_array(F.collect_set((F.col("vec_id") % 7).cast("string"))), ", ").alias("Words")
    )
    from .q_labels import scratch

    path = scratch(spark, "topic-words")
    writers.export_csv(packed.withColumnRenamed("label", "Topic"), path)
    return readers.read_topic_words(spark, path)

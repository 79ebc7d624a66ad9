"""Queries over the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, text as tx
from ..operators import clean
from . import views as v
from .registry import query

W = "WITH " + v.REVIEWS


@query("drop_missing_text", f"{W} SELECT comment_id, reponse FROM reviews WHERE reponse IS NOT NULL")
def _(spark, sf):
    return clean.drop_missing_text(v.reviews(spark, sf).select("comment_id", "reponse"), "reponse")


@query(
    "blank_to_null",
    f"""SELECT conv_id, turn, CASE WHEN t NOT IN ('', 'nan', 'NaT') THEN t END AS text
        FROM (SELECT conv_id, turn, {v.sql_strip("CASE WHEN turn % 4 = 1 THEN ' nan ' WHEN turn % 4 = 2 THEN '  ' ELSE text END")} AS t
              FROM conversations)""",
)
def _(spark, sf):
    c = v.table(spark, sf, "conversations")
    spoiled = F.when(F.col("turn") % 4 == 1, " nan ").when(F.col("turn") % 4 == 2, "  ").otherwise(F.col("text"))
    return clean.blank_to_null(c.select("conv_id", "turn", spoiled.alias("text")), ["text"])


@query(
    "dedup_keep_first",
    """SELECT comment_id, client, length(commentaire) AS chars FROM (
         SELECT doc_id AS comment_id, text AS commentaire, concat('c', CAST(doc_id % 3 AS VARCHAR)) AS client,
                row_number() OVER (PARTITION BY text, doc_id % 3 ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def _(spark, sf):
    rows = v.reviews(spark, sf).withColumn("client", F.concat(F.lit("c"), (F.col("comment_id") % 3).cast("string")))
    kept = clean.dedup_keep_first(rows.select("comment_id", "commentaire", "client"))
    return kept.select("comment_id", "client", F.length("commentaire").cast("bigint").alias("chars"))


@query("word_count", f"{W} SELECT comment_id, {v.sql_word_count('commentaire')} AS words FROM reviews")
def _(spark, sf):
    return v.reviews(spark, sf).select("comment_id", tx.word_count("commentaire").alias("words"))


SIMPLE = rf"""regexp_replace(regexp_replace(lower(commentaire), 'http[^{v.BLANK}]+|www[^{v.BLANK}]+', '', 'g'),
 '[^{v.BLANK}]+@[^{v.BLANK}]+', '', 'g')"""
SIMPLE = v.sql_strip(
    rf"regexp_replace(regexp_replace({SIMPLE}, '[^{tx.LETTERS}0-9{v.BLANK}''-]', ' ', 'g'), '[{v.BLANK}]+', ' ', 'g')"
)


@query(
    "word_count_simple",
    rf"""{W}, c AS (SELECT comment_id, {SIMPLE} AS t FROM reviews)
    SELECT comment_id, CAST(len(list_filter(regexp_split_to_array(t, '[{v.BLANK}]+'), lambda x: x <> '')) AS INT) AS words FROM c""",
)
def _(spark, sf):
    text = tx.clean_simple("commentaire")
    return v.reviews(spark, sf).select("comment_id", tx.word_count_simple(text).alias("words"))


@query("min_words_filter", f"{W} SELECT comment_id FROM reviews WHERE {v.sql_word_count('commentaire')} > 3")
def _(spark, sf):
    return clean.min_words_filter(v.reviews(spark, sf)).select("comment_id")


@query("clean_general", f"{W} SELECT comment_id, {v.sql_clean('commentaire')} AS clean_comment FROM reviews")
def _(spark, sf):
    return v.clean_reviews(spark, sf).select("comment_id", "clean_comment")


@query("clean_general_pages", f"SELECT page_id, {v.sql_clean('html')} AS clean_html FROM pages")
def _(spark, sf):
    return v.text_table(spark, sf, "pages").select("page_id", tx.clean_general("html").alias("clean_html"))


@query("clean_simple", f"{W} SELECT comment_id, {SIMPLE} AS comment_clean FROM reviews")
def _(spark, sf):
    return v.reviews(spark, sf).select("comment_id", tx.clean_simple("commentaire").alias("comment_clean"))


SQL_LETTERS = rf"""array_to_string(list_filter(string_split(regexp_replace(lower(coalesce(commentaire, '')), '[^{tx.LETTERS} ]', ' ', 'g'), ' '),
 lambda x: length(x) > 2 AND x NOT IN ({v.lit(v.STOPS)})), ' ')"""


@query("clean_letters_stop", f"{W} SELECT comment_id, {SQL_LETTERS} AS comment_clean FROM reviews")
def _(spark, sf):
    return v.reviews(spark, sf).select("comment_id", tx.clean_letters_stop("commentaire", v.STOPS).alias("comment_clean"))


@query(
    "clean_stripped_stop",
    rf"""{W} SELECT comment_id, array_to_string(list_filter(regexp_extract_all(
      regexp_replace(lower(commentaire), '[^a-zà-ÿ{v.BLANK}]', '', 'g'), '[^{v.BLANK}]+'),
      lambda x: x NOT IN ({v.lit(fv.TOPIC_CLEAN_WORDS)})), ' ') AS doc FROM reviews""",
)
def _(spark, sf):
    return v.reviews(spark, sf).select(
        "comment_id", tx.clean_stripped_stop("commentaire", fv.TOPIC_CLEAN_WORDS).alias("doc")
    )


@query("lower_or_empty", f"{W} SELECT comment_id, coalesce(lower(commentaire), '') AS t, coalesce(lower(reponse), '') AS r FROM reviews")
def _(spark, sf):
    return v.reviews(spark, sf).select(
        "comment_id", tx.lower_or_empty("commentaire").alias("t"), tx.lower_or_empty("reponse").alias("r")
    )


@query(
    "char_length",
    f"""{W} SELECT comment_id, CAST(length(coalesce(commentaire, '')) AS INT) AS chars,
        CAST(length(coalesce(reponse, '')) AS INT) AS answer_chars FROM reviews""",
)
def _(spark, sf):
    return v.reviews(spark, sf).select(
        "comment_id", tx.char_length("commentaire").alias("chars"), tx.char_length("reponse").alias("answer_chars")
    )


LEMMAS = [("thand", "than"), ("ering", "er"), ("inea", "in"), ("elle", "el"), ("ieren", "ier"), ("chen", "ch"), ("anea", "an")]


@query(
    "tokenize_filter",
    f"""WITH {v.TOKENS}, lem AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in LEMMAS)}) t(form, lemma)),
    e AS (SELECT comment_id, unnest(clean_tokens) AS form, generate_subscripts(clean_tokens, 1) AS pos FROM toks)
    SELECT t.comment_id, coalesce(string_agg(coalesce(lemma, e.form), ' ' ORDER BY pos), '') AS tokens
    FROM toks t LEFT JOIN e ON e.comment_id = t.comment_id LEFT JOIN lem ON lem.form = e.form GROUP BY t.comment_id""",
)
def _(spark, sf):
    lemmas = spark.createDataFrame(LEMMAS, "form string, lemma string")
    rows = clean.tokenize_filter(v.reviews(spark, sf).select("comment_id", "commentaire"), "commentaire", v.STOPS, lemmas)
    return rows.select("comment_id", F.array_join("clean_tokens", " ").alias("tokens"))


@query("join_tokens", f"WITH {v.TOKENS} SELECT comment_id, array_to_string(clean_tokens, ' ') AS clean_text FROM toks")
def _(spark, sf):
    return clean.join_tokens(v.token_reviews(spark, sf)).select("comment_id", "clean_text")


@query(
    "remove_product_words",
    f"""WITH {v.TOKENS} SELECT comment_id, array_to_string(list_filter(clean_tokens,
      lambda x: x NOT IN ({v.lit(v.DOMAIN_WORDS + fv.PRODUCT_WORDS)})), ' ') AS comment_sans_contexte FROM toks""",
)
def _(spark, sf):
    rows = clean.remove_product_words(v.token_reviews(spark, sf), v.DOMAIN_WORDS + fv.PRODUCT_WORDS)
    return rows.select("comment_id", "comment_sans_contexte")


_low = v.sql_strip("lower(commentaire)")
_url = f"regexp_replace(lowered, '(http|www)[^{v.BLANK}]+', '', 'g')"
_mail = f"regexp_replace(no_url, '[^{v.BLANK}]+@[^{v.BLANK}]+', '', 'g')"
_tag = f"regexp_replace(no_mail, '(@|#)[{v.WORD}]+', '', 'g')"
_squeezed = f"regexp_replace(no_tag, '[{v.BLANK}]+', ' ', 'g')"


@query(
    "cleaning_trace",
    f"""{W}, a AS (SELECT comment_id, commentaire AS raw, {_low} AS lowered FROM reviews),
    b AS (SELECT *, {_url} AS no_url FROM a), c AS (SELECT *, {_mail} AS no_mail FROM b),
    d AS (SELECT *, {_tag} AS no_tag FROM c), e AS (SELECT *, {v.sql_strip(_squeezed)} AS clean FROM d),
    f AS (SELECT *, {v.sql_letter_tokens('clean')} AS t FROM e)
    SELECT comment_id, raw, lowered, no_url, no_mail, no_tag, clean, array_to_string(t, ' ') AS tokens_text,
      array_to_string(list_filter(t, lambda x: x NOT IN ({v.lit(v.DOMAIN_WORDS)})), ' ') AS comment_sans_contexte,
      {v.sql_word_count('raw')} AS words FROM f""",
)
def _(spark, sf):
    return clean.cleaning_trace(v.reviews(spark, sf), v.STOPS, v.DOMAIN_WORDS)


@query(
    "cleaning_funnel",
    f"""{W}, r AS (SELECT *, concat('c', CAST(comment_id % 3 AS VARCHAR)) AS who, {v.sql_word_count('commentaire')} AS words FROM reviews),
    d AS (SELECT *, row_number() OVER (PARTITION BY commentaire, who ORDER BY comment_id) AS rn FROM r)
    SELECT CAST(count(*) AS BIGINT) AS raw, CAST(count(commentaire) AS BIGINT) AS with_text,
      CAST(count(*) FILTER (rn = 1 AND commentaire IS NOT NULL) AS BIGINT) AS deduplicated,
      CAST(count(*) FILTER (rn = 1 AND words > 3) AS BIGINT) AS long_enough,
      CAST(count(*) FILTER (rn = 1 AND words > 3 AND lang = 'fr') AS BIGINT) AS in_language FROM d""",
)
def _(spark, sf):
    rows = v.reviews(spark, sf).withColumn("client", F.concat(F.lit("c"), (F.col("comment_id") % 3).cast("string")))
    return clean.cleaning_funnel(rows)


def _sql_grams(c):
    plain = rf"(' ' || trim(regexp_replace(lower({c}), '[^\p{{L}}]+', ' ', 'g')) || ' ')"
    return " || ".join(f"regexp_extract_all({x}, '.{{3}}')" for x in (plain, f"substr({plain}, 2)", f"substr({plain}, 3)"))


def _each(form):
    return ", ".join(form.replace("@", c) for c in v.LANGUAGES)


PROFILE = f"""
  counted AS (SELECT term, {_each("count(*) FILTER (lang = '@') AS n_@")} FROM
     (SELECT lang, unnest({_sql_grams('commentaire')}) AS term FROM reviews WHERE lang IN ({v.lit(v.LANGUAGES)})) GROUP BY term HAVING count(*) >= 2),
  total AS (SELECT count(*) AS v, {_each("coalesce(sum(n_@), 0) AS t_@")} FROM counted),
  prof AS (SELECT term, {_each("CAST(floor(1000 * ln(CAST(n_@ + 1 AS DOUBLE) / CAST(t_@ + v + 1 AS DOUBLE))) AS BIGINT) AS p_@")} FROM counted, total),
  rest AS (SELECT {_each("CAST(floor(1000 * ln(1::DOUBLE / CAST(t_@ + v + 1 AS DOUBLE))) AS BIGINT) AS r_@")} FROM total),
  cl AS (SELECT comment_id, {v.sql_clean('commentaire')} AS clean_comment FROM reviews),
  tk AS (SELECT comment_id, unnest({_sql_grams('clean_comment')}) AS term FROM cl WHERE length(clean_comment) >= 10),
  sums AS (SELECT comment_id, {_each("sum(coalesce(p_@, r_@)) AS w_@")} FROM tk LEFT JOIN prof USING (term), rest GROUP BY comment_id),
  det AS (SELECT r.comment_id, CASE greatest({", ".join(f"w_{c}" for c in v.LANGUAGES)})
     {" ".join(f"WHEN w_{c} THEN '{c}'" for c in v.LANGUAGES)} END AS lang_detected FROM reviews r LEFT JOIN sums s ON s.comment_id = r.comment_id)"""


def detected(spark, sf):
    rows = v.clean_reviews(spark, sf)
    profile = clean.detect_profile(v.reviews(spark, sf), "commentaire", "lang", v.LANGUAGES)
    return clean.detect_language(rows, profile, v.LANGUAGES)


@query("detect_language", f"{W}, {PROFILE} SELECT comment_id, lang_detected, CASE WHEN lang_detected IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS lang_score FROM det")
def _(spark, sf):
    return detected(spark, sf).select("comment_id", "lang_detected", "lang_score")


@query("filter_language", f"{W}, {PROFILE} SELECT comment_id FROM det WHERE lang_detected = 'fr'")
def _(spark, sf):
    return clean.filter_language(detected(spark, sf)).select("comment_id")


@query("lang_group", f"{W} SELECT comment_id, CASE WHEN lang = 'fr' THEN 'fr' ELSE 'Autres' END AS lang_group FROM reviews")
def _(spark, sf):
    return v.reviews(spark, sf).select("comment_id", tx.lang_group("lang").alias("lang_group"))


@query(
    "contains_term",
    f"""{W} SELECT comment_id, CAST(coalesce(regexp_matches(lower(commentaire), 'tion'), false) AS INT) AS has_term,
      CAST(coalesce(contains(reponse, 'ok'), false) AS INT) AS has_ok FROM reviews""",
)
def _(spark, sf):
    return v.reviews(spark, sf).select(
        "comment_id",
        tx.contains_term(F.lower("commentaire"), "tion").alias("has_term"),
        tx.contains_term("reponse", "ok").alias("has_ok"),
    )


@query(
    "split_sentences",
    f"""{W} SELECT comment_id, CAST(len({v.sql_sentences(v.sql_clean('commentaire'))}) AS INT) AS n,
      array_to_string({v.sql_sentences(v.sql_clean('commentaire'))}, '|') AS sentences FROM reviews""",
)
def _(spark, sf):
    parts = tx.split_sentences("clean_comment")
    rows = v.clean_reviews(spark, sf).select("comment_id", parts.alias("s"))
    return rows.select("comment_id", F.size("s").alias("n"), F.array_join("s", "|").alias("sentences"))


@query("explode_sentences", f"WITH {v.SENTENCES} SELECT comment_id, sent_no, sentence FROM sentences")
def _(spark, sf):
    return v.sentences(spark, sf).select("comment_id", "sent_no", "sentence")


_kw = "tion(s)?|ment(s)?|keit(en)?"


@query(
    "matched_keyword",
    rf"""{W} SELECT comment_id, nullif(regexp_extract(lower(commentaire), '(^|[^{v.WORD}])({_kw})($|[^{v.WORD}])', 2), '') AS keyword FROM reviews""",
)
def _(spark, sf):
    pattern = tx.whole_words([_kw])
    return v.reviews(spark, sf).select("comment_id", tx.matched_keyword(F.lower("commentaire"), pattern).alias("keyword"))

"""Word, n-gram and TF-IDF features in long form (id, term, weight)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..session import store
from . import relational
from .rows import explode_rows


def word_freq(df: DataFrame, tokens: Column, k: int | None = None) -> DataFrame:
    """Corpus counts of tokens, the ``k`` commonest if given."""
    counts = explode_rows(df, tokens, "term").groupBy("term").agg(F.count("*").alias("n"))
    return counts if k is None else relational.top_k(counts, "n", "term", k)


def word_freq_by_star(df: DataFrame, tokens: Column, star: str = "star", k: int = 200, grouped: bool = True) -> DataFrame:
    """The ``k`` commonest words of the bad (1-2) and good (4-5) reviews, or of every star."""
    bucket = F.when(F.col(star) <= 2, "bad").when(F.col(star) >= 4, "good") if grouped else F.col(star)
    words = df.select(bucket.alias("bucket"), tokens.alias("_t")).filter(F.col("bucket").isNotNull())
    counts = explode_rows(words, "_t", "term", "bucket").groupBy("bucket", "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


LISTED = 20_000  # words or terms that may stand in an expression as a list
FIRST_WORDS = 2000


def _grams_of(kept: str, low: int, high: int) -> Column:
    """N-grams of a column of tokens; null where a token is null."""

    def of_size(n: int) -> Column:
        if n == 1:
            return F.col(kept)
        starts = F.when(F.size(kept) >= n, F.sequence(F.lit(0), F.size(kept) - n))
        parts = lambda i: [x for j in range(n) for x in (F.lit(" "), F.get(kept, i + j))][1:]
        return F.coalesce(F.transform(starts, lambda i: F.concat(*parts(i))), F.array().cast("array<string>"))

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


def top_ngrams(stored: DataFrame, tokens: str, low: int, high: int, k: int) -> DataFrame:
    """(term, n): the ``k`` commonest n-grams of a stored table's tokens, ties to the smaller; exact.

    An n-gram is at most as frequent as each of its words. The k-th count among n-grams of some common words bounds the
    k-th of all from below, so words under that bound are in none of the k; if all words from it up were counted, that is
    the result, else n-grams of just those are counted again. Too many words to list: every n-gram is counted.
    """
    words = store(word_freq(stored, F.col(tokens)), "word-counts")

    def best(listed: list[str]) -> DataFrame:
        # A column of its own: inside the n-grams it would be made again for each of them.
        kept = stored.select(F.transform(tokens, lambda t: F.when(t.isin(listed), t)).alias("_kept"))
        return store(word_freq(kept, _grams_of("_kept", low, high), k), "ngram-counts")

    first = relational.top_k(words, "n", "term", FIRST_WORDS).collect()
    found = best([r["term"] for r in first])
    number, bound = found.agg(F.count("*"), F.min("n")).first()
    bound = bound if number == k else 1
    if words.filter(F.col("n") >= bound).limit(len(first) + 1).count() <= len(first):
        return found
    needed = words.filter(F.col("n") >= bound).select("term").limit(LISTED + 1).collect()
    if len(needed) > LISTED:
        return word_freq(stored, tx.ngrams(F.col(tokens), low, high), k)
    return best([r["term"] for r in needed])


def ngram_counts(
    df: DataFrame, text: str, stops: Iterable[str] = (), low: int = 2, high: int = 2, k: int | None = 20
) -> DataFrame:
    """Counts of n-grams over the analyser tokens, stop words removed before the n-grams are formed. With ``k`` only
    n-grams that may be among the commonest are counted, from tokens stored once."""
    tokens = df.select(tx.drop_words(tx.analyzer_tokens(text), stops).alias("_tokens"))
    if k is None:
        return word_freq(tokens, tx.ngrams(F.col("_tokens"), low, high)).withColumnRenamed("term", "ngram")
    return top_ngrams(store(tokens, "tokens"), "_tokens", low, high, k).withColumnRenamed("term", "ngram")


def ngram_star_distribution(df: DataFrame, top: DataFrame, text: str = "commentaire", star: str = "star") -> DataFrame:
    """Reviews per (n-gram, star) whose lower-case text contains the n-gram literally.

    ``top`` is a top-k table; it reaches the scan of the texts as one scalar array, so the texts are
    neither joined nor shuffled.
    """
    patterns = top.agg(F.collect_list("ngram")).scalar()
    lowered = df.select(star, F.lower(text).alias("_t"), patterns.alias("_p"))
    hits = explode_rows(lowered, F.filter("_p", lambda g: F.contains(F.col("_t"), g)), "ngram", star)
    return hits.groupBy("ngram", star).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class TfidfParams:
    """Vocabulary choice: document-frequency limits are inclusive, ``max_features`` keeps the commonest terms."""

    low: int = 1
    high: int = 1
    min_df: int = 1
    max_df: float = 1.0
    max_features: int | None = None
    stops: tuple[str, ...] = ()


def term_counts(df: DataFrame, id: str, tokens: Column, params: TfidfParams = TfidfParams()) -> DataFrame:
    """(id, term, tf). Documents move once, as token lists, so that counting terms and later the vector
    norms need no further exchange of the far larger term rows."""
    docs = df.select(id, tx.drop_words(tokens, params.stops).alias("_tokens")).repartition(id)
    terms = tx.ngrams(F.col("_tokens"), params.low, params.high)
    return explode_rows(docs, terms, "term", id).groupBy(id, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, documents: Column, params: TfidfParams = TfidfParams()) -> DataFrame:
    """(term, df, cf, idf) with the smoothed idf ln((1 + n) / (1 + df)) + 1."""
    found = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    if params.min_df > 1:
        found = found.filter(F.col("df") >= params.min_df)
    if params.max_df < 1.0:
        found = found.filter(F.col("df") <= params.max_df * documents)
    if params.max_features is not None:
        found = relational.top_k(found, "cf", "term", params.max_features)
    return found.withColumn("idf", F.log((F.lit(1.0) + documents) / (F.lit(1.0) + F.col("df"))) + 1)


def weigh(counts: DataFrame, vocab: DataFrame, id: str, single_idf: Column | None = None) -> DataFrame:
    """(id, term, w): tf times idf, unit length per document. Terms outside the vocabulary are left out.

    ``single_idf`` says that every counted term is in the vocabulary and gives the idf of a term found in one
    document: such terms, the bulk of an unpruned vocabulary, then need no lookup.
    """
    if single_idf is None:
        found, idf = counts.join(vocab.select("term", "idf"), "term"), F.col("idf")
    else:
        shared = vocab.filter(F.col("df") > 1).select("term", "idf")
        found, idf = counts.join(shared, "term", "left"), F.coalesce("idf", single_idf)
    raw = found.select(id, "term", (F.col("tf") * idf).alias("_w"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id)))
    return raw.select(id, "term", (F.col("_w") / length).alias("w"))


def tfidf_fit(df: DataFrame, id: str, tokens: Column, params: TfidfParams = TfidfParams()) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, weights) of a corpus; ``id`` must be unique.

    A vocabulary of the commonest terms alone is found first, and no other term becomes a row.
    """
    documents = df.agg(F.count("*")).scalar()
    if params.max_features is not None and 0 < params.max_features <= LISTED and params.min_df <= 1 and params.max_df >= 1.0:
        stored = store(df.select(id, tx.drop_words(tokens, params.stops).alias("_tokens")), "tokens")
        listed = [r["term"] for r in top_ngrams(stored, "_tokens", params.low, params.high, params.max_features).collect()]
        terms = F.filter(tx.ngrams(F.col("_tokens"), params.low, params.high), lambda t: t.isin(listed))
        docs = stored.select(id, terms.alias("_terms")).repartition(id)
        counts = explode_rows(docs, "_terms", "term", id).groupBy(id, "term").agg(F.count("*").alias("tf"))
    else:
        counts = term_counts(df, id, tokens, params)
    vocab = vocabulary(counts, documents, params)
    whole = params.min_df <= 1 and params.max_df >= 1.0 and params.max_features is None
    return vocab, weigh(counts, vocab, id, F.log((F.lit(1.0) + documents) / 2) + 1 if whole else None)


def tfidf(df: DataFrame, id: str, tokens: Column, params: TfidfParams = TfidfParams()) -> DataFrame:
    return tfidf_fit(df, id, tokens, params)[1]


def tfidf_top_terms(weights: DataFrame, k: int = 20, documents: Column | None = None) -> DataFrame:
    """Terms by summed weight, or by mean weight over all ``documents`` when their number is given."""
    total = F.sum("w") if documents is None else F.sum("w") / F.first(documents)
    ranked = weights.groupBy("term").agg(total.alias("_s")).select("term", F.round("_s", 6).alias("score"))
    return relational.top_k(ranked, "score", "term", k)


def tfidf_transform(df: DataFrame, id: str, tokens: Column, vocab: DataFrame, params: TfidfParams = TfidfParams()) -> DataFrame:
    """Weights of new texts under a stored vocabulary and idf."""
    return weigh(term_counts(df, id, tokens, params), vocab, id)

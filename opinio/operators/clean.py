"""Row filters, text cleaning, sentence splitting and language detection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..session import collect_bounded, count_up_to, store
from .rows import explode_rows, posexplode_rows


def drop_missing_text(df: DataFrame, text: str = "commentaire") -> DataFrame:
    return df.dropna(subset=[text])


def blank_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: tx.blank_to_null(c) for c in columns})


def dedup_keep_first(
    df: DataFrame, keys: Sequence[str] = ("commentaire", "client"), order: str = "comment_id"
) -> DataFrame:
    """First row, by the unique column ``order``, of each combination of keys; nulls are equal.

    The winners are found on fixed-size digests with a map-side minimum, so a text repeated in a
    third of all rows costs one small row per task and no sort of its copies.
    """
    digests = [F.sha2(F.col(k).cast("string"), 256).alias(f"_key{i}") for i, k in enumerate(keys)]
    winners = (
        df.select(*digests, F.col(order))
        .groupBy(*[f"_key{i}" for i in range(len(keys))])
        .agg(F.min(order).alias(order))
        .select(order)
    )
    return df.join(winners, order, "left_semi")


def min_words_filter(df: DataFrame, text: str = "commentaire", more_than: int = 3) -> DataFrame:
    return df.filter(tx.more_words(text, more_than))


def tokenize_filter(
    df: DataFrame,
    text: str,
    stops: Iterable[str],
    lemmas: DataFrame | None = None,
    min_length: int = 3,
    id: str = "comment_id",
    out: str = "clean_tokens",
) -> DataFrame:
    """Alphabetic tokens without stop words and short words, each replaced by its lemma if it has one.

    Without a lemma table this is a projection. With one, ``lemmas(form, lemma)`` is joined to the
    exploded tokens (broadcast when Spark's size limit allows, else a skew-handled shuffle join) and each
    document is put back together in token order; the text columns do not travel with the tokens.
    """
    kept = tx.drop_words(F.filter(tx.letter_tokens(text), lambda t: F.length(t) >= min_length), stops)
    if lemmas is None:
        return df.withColumn(out, kept)
    tokens = posexplode_rows(df, kept, "_pos", "form", id)
    named = tokens.join(lemmas.select("form", "lemma"), "form", "left").select(
        id, F.struct("_pos", F.coalesce("lemma", "form").alias("_t")).alias("_token")
    )
    lists = named.groupBy(id).agg(F.sort_array(F.collect_list("_token"))["_t"].alias(out))
    return df.join(lists, id, "left").withColumn(
        out, F.coalesce(out, F.when(F.col(text).isNotNull(), F.array().cast("array<string>")))
    )


def join_tokens(df: DataFrame, tokens: str = "clean_tokens", out: str = "clean_text") -> DataFrame:
    return df.withColumn(out, F.array_join(tokens, " "))


def remove_product_words(
    df: DataFrame, words: Iterable[str], tokens: str = "clean_tokens", out: str = "comment_sans_contexte"
) -> DataFrame:
    """Tokens without the listed domain words, repeats kept, as one text."""
    return df.withColumn(out, F.array_join(tx.drop_words(F.col(tokens), words), " "))


def cleaning_trace(
    df: DataFrame, stops: Iterable[str], product_words: Iterable[str], text: str = "commentaire", id: str = "comment_id"
) -> DataFrame:
    """One row per review with every intermediate text."""
    steps = tx.clean_steps(text)
    traced = df.select(id, F.col(text).alias("raw"), *[c.alias(n) for n, c in steps.items()])
    traced = tokenize_filter(traced, "clean", stops, id=id)
    traced = join_tokens(traced, out="tokens_text")
    traced = remove_product_words(traced, product_words)
    return traced.withColumn("words", tx.word_count("raw")).drop("clean_tokens")


SLICE_CHARS = 2_000_000  # characters handled at once in a task
PROFILE_ROWS = 500_000  # a profile up to this size is held by every task


def _gram_slices(texts: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first, gram) of the texts in bounded slices: the rows with a gram, where each one's grams begin in ``gram``,
    and all runs of three characters as one number each, 21 bits a character."""
    lengths = texts.str.len().to_numpy()
    cuts = np.searchsorted(np.cumsum(lengths), np.arange(SLICE_CHARS, lengths.sum(), SLICE_CHARS), "right")
    for rows in np.split(np.arange(len(texts)), np.unique(cuts)):
        if not (sizes := np.maximum(lengths[rows] - 2, 0)).sum():
            continue
        chars = np.frombuffer("".join(texts.iloc[rows]).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        whole = np.ones(len(chars), dtype=bool)
        ends = np.cumsum(lengths[rows])
        for back in (1, 2):
            at = ends[lengths[rows] >= back] - back
            whole[at] = False
        gram = (chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])[whole[:-2]]
        some = sizes > 0
        yield rows[some], (np.cumsum(sizes) - sizes)[some], gram


def _as_text(gram: int) -> str:
    return "".join(chr(gram >> shift & 0x1FFFFF) for shift in (42, 21, 0))


def _as_number(term: str) -> int:
    return ord(term[0]) << 42 | ord(term[1]) << 21 | ord(term[2])


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, lang, n): a task's counts, passed on whenever they grow large."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def told(lang: str) -> pd.DataFrame:
        grams, n = held.pop(lang)
        return pd.DataFrame({"term": [_as_text(g) for g in grams.tolist()], "lang": lang, "n": n})

    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            for _, _, gram in _gram_slices(texts):
                grams, n = np.unique(gram, return_counts=True)
                if lang in held:
                    grams, place = np.unique(np.concatenate([held[lang][0], grams]), return_inverse=True)
                    n = np.bincount(place, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = grams, n
                if len(grams) > PROFILE_ROWS:
                    yield told(lang)
    for lang in list(held):
        yield told(lang)


def detect_profile(
    labelled: DataFrame, text: str, lang: str, languages: Sequence[str], min_count: int = 2
) -> DataFrame:
    """(term, w_<language>...): smoothed log probabilities, in thousandths, of the character trigrams that occur
    ``min_count`` times or more in the labelled texts; the row of the empty term is for every other trigram.

    Stored, as it is read for its size, its rest row and its look-ups. It grows with the trigrams of the languages'
    alphabets, not with the texts. Tasks count their own trigrams in numpy and pass on one row of each.
    """
    rows = labelled.filter(F.col(lang).isin(list(languages))).select(F.col(lang).alias("lang"), tx.plain_letters(text).alias("text"))
    per_language = [F.coalesce(F.sum(F.when(F.col("lang") == code, F.col("n"))), F.lit(0)).alias(f"n_{code}") for code in languages]
    found = rows.filter(F.col("text").isNotNull()).mapInPandas(_count_grams, "term string, lang string, n bigint")
    counts = found.groupBy("term").agg(*per_language)
    kept = store(counts.filter(sum(F.col(f"n_{code}") for code in languages) >= min_count), "language-counts")
    rest = labelled.sparkSession.range(1).select(F.lit("").alias("term"), *[F.lit(0).cast("bigint").alias(f"n_{c}") for c in languages])
    size = kept.agg(F.struct(F.count("*").alias("v"), *[F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(f"t_{c}") for c in languages])).scalar()
    weights = [
        F.floor(1000 * F.ln((F.col(f"n_{c}") + 1).cast("double") / (size[f"t_{c}"] + size["v"] + 1).cast("double"))).alias(f"w_{c}")
        for c in languages
    ]
    return store(kept.unionByName(rest).select("term", *weights), "language-profile")


def _gram_sums(plain: DataFrame, profile: DataFrame, columns: Sequence[str], id: str) -> DataFrame:
    """(id, summed weights) of each row of (id, text) with a trigram, by a profile that every task holds."""
    known = collect_bounded(profile.select("term", *columns), PROFILE_ROWS, "language profile")
    rest = next([r[c] for c in columns] for r in known if r["term"] == "")
    known = sorted((_as_number(r["term"]), *(r[c] for c in columns)) for r in known if r["term"])
    grams = np.array([r[0] for r in known], dtype=np.int64)
    weights = np.array([r[1:] for r in known] + [rest], dtype=np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, first, gram in _gram_slices(batch.column("text").to_pandas()):
                place = np.searchsorted(grams, gram)
                met = place < len(grams)
                met[met] = grams[place[met]] == gram[met]
                place[~met] = len(grams)
                total = np.add.reduceat(weights[place], first, axis=0)
                cells = [pa.array(np.ascontiguousarray(t)) for t in total.T]
                yield pa.RecordBatch.from_arrays([batch.column(id).take(pa.array(rows)), *cells], names=[id, *columns])

    schema = f"`{id}` {plain.schema[id].dataType.simpleString()}, " + ", ".join(f"`{c}` bigint" for c in columns)
    return plain.mapInArrow(sums, schema)


def _gram_rows(plain: DataFrame, profile: DataFrame, columns: Sequence[str], id: str) -> DataFrame:
    """The same, a row per trigram before the sums, by a join with a profile of any size."""
    rest = profile.filter(F.col("term") == "").select(F.struct(*columns)).scalar()
    met = explode_rows(plain, tx.letter_grams("text"), "term", id).join(profile, "term", "left")
    return met.select(id, *[F.coalesce(c, rest[c]).alias(c) for c in columns])


def detect_language(
    df: DataFrame,
    profile: DataFrame,
    languages: Sequence[str],
    text: str = "clean_comment",
    id: str = "comment_id",
    target: str = "fr",
    min_chars: int | None = 10,
) -> DataFrame:
    """Adds ``lang_detected`` (the language under which the text's trigrams are likeliest; null for texts without a
    letter or under ``min_chars``) and ``lang_score`` (1.0 when a language was found, else 0.0), one row per id.

    Every task holds a profile of up to ``PROFILE_ROWS`` rows and sums a text's trigrams in numpy; a larger profile is
    joined. Either way a text collapses to one row of sums before the only shuffle.
    """
    plain = tx.plain_letters(text)
    # A condition inside the projection, not a filter: a filter would be pushed below the cleaning of the
    # text and repeat it.
    usable = plain if min_chars is None else F.when(F.length(tx.strip(text)) >= min_chars, plain)
    columns = [f"w_{code}" for code in languages]
    texts = df.select(id, F.coalesce(usable, F.lit("")).alias("text"))
    sums_of = _gram_sums if count_up_to(profile, PROFILE_ROWS) <= PROFILE_ROWS else _gram_rows
    sums = sums_of(texts, profile, columns, id).groupBy(id).agg(*[F.sum(c).alias(c) for c in columns])
    best = F.greatest(*[F.col(c) for c in columns])
    choice = F.coalesce(*[F.when(F.col(f"w_{c}") == best, F.lit(c)) for c in sorted(languages)])
    return df.join(sums.select(id, choice.alias("lang_detected")), id, "left").withColumn(
        "lang_score", F.col("lang_detected").isNotNull().cast("double")
    )


def filter_language(df: DataFrame, target: str = "fr", lang: str = "lang_detected") -> DataFrame:
    return df.filter(F.col(lang) == target)


def explode_sentences(
    df: DataFrame, text: str = "clean_comment", more_than: int = 3, keep: Sequence[str] = ("comment_id",)
) -> DataFrame:
    """One row per sentence of more than ``more_than`` words, numbered within its review from 0."""
    rows = posexplode_rows(df, tx.split_sentences(text), "sent_no", "sentence", *keep)
    return min_words_filter(rows, "sentence", more_than)


def cleaning_funnel(
    df: DataFrame,
    text: str = "commentaire",
    client: str = "client",
    lang: str = "lang",
    id: str = "comment_id",
    target: str = "fr",
    more_than: int = 3,
) -> DataFrame:
    """Row counts after each cleaning stage, in one pass: rows collapse per (text, client) first."""
    groups = df.groupBy(F.sha2(text, 256).alias("_text"), F.col(client).alias("_client")).agg(
        F.count("*").alias("n"),
        F.min(tx.word_count(text)).alias("words"),
        F.min_by(lang, id).alias("first_lang"),
    )
    present = F.col("_text").isNotNull()
    long_enough = present & (F.col("words") > more_than)
    return groups.agg(
        F.sum("n").alias("raw"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("with_text"),
        F.count_if(present).alias("deduplicated"),
        F.count_if(long_enough).alias("long_enough"),
        F.count_if(long_enough & (F.col("first_lang") == target)).alias("in_language"),
    )

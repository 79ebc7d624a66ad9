"""Profiling of a review table: counts, rates, bins and order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, text as tx
from .quantiles import exact_quantiles


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type, non-null and null counts, null percentage; one pass over the data."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"_n{i}").alias("non_null"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    rows = counts.select("_rows", F.explode(entries).alias("e")).select("_rows", "e.*")
    nulls = F.col("_rows") - F.col("non_null")
    return rows.select(
        "column",
        "type",
        F.col("_rows").alias("rows"),
        "non_null",
        nulls.alias("nulls"),
        F.when(F.col("_rows") > 0, F.round(100.0 * nulls / F.col("_rows"), 6)).alias("null_pct"),
    )


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _with_quartiles(stats: DataFrame, box: DataFrame, by: Sequence[str]) -> DataFrame:
    """``stats`` next to the quartiles of its group, a null group included; a group without values has null quartiles."""
    if not by:
        found = box.select(F.struct(*QUARTILES)).scalar()
        return stats.select("*", *[found[q].alias(q) for q in QUARTILES])
    theirs = box.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], *QUARTILES)
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & stats[k].eqNullSafe(theirs[f"_by{i}"])
    return stats.join(theirs, on, "left").drop(*[f"_by{i}" for i in range(len(by))])


def describe_numeric(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of a measure, overall or per group."""
    moments = [
        F.count(value).alias("count"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.stddev_samp(value), 6).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    ]
    both = _with_quartiles(df.groupBy(*by).agg(*moments), exact_quantiles(df, value, QUARTILES, by), by)
    quartiles = [F.round(q, 6).alias(q) for q in QUARTILES]
    if by:
        return both.select(*by, "count", "mean", "std", "min", "max", *quartiles)
    return both.select("count", "mean", "std", "min", *quartiles, "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, commonest first, nulls left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column)


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Percentage of rows per value, nulls left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / counts.agg(F.sum("n")).scalar(), 6))


def presence_rate(df: DataFrame, by: str, column: str, out: str, percent: bool) -> DataFrame:
    """Share of rows with a non-null ``column`` per group."""
    rate = F.avg(F.col(column).isNotNull().cast("double"))
    return df.groupBy(by).agg(F.round(100 * rate if percent else rate, 6).alias(out))


def comment_rate_by_star(df: DataFrame, text: str = "commentaire", star: str = "star") -> DataFrame:
    return presence_rate(df.withColumn(text, tx.blank_to_null(text)), star, text, "comment_pct", True)


def comment_presence_by_star(df: DataFrame, text: str = "commentaire", star: str = "star") -> DataFrame:
    has = tx.blank_to_null(text).isNotNull().cast("int")
    return df.groupBy(star, has.alias("has_comment")).agg(F.count("*").alias("n"))


def response_rate_by_star(df: DataFrame, answer: str = "reponse", star: str = "star") -> DataFrame:
    return presence_rate(df, star, answer, "response_rate", False)


def _with_without(answer: str) -> list[Column]:
    """Counts without and with an answer; as plain sums a group lacking one kind gets 0."""
    has = F.col(answer).isNotNull()
    return [F.count_if(~has).alias("without_response"), F.count_if(has).alias("with_response")]


def response_counts_by_star(df: DataFrame, answer: str = "reponse", star: str = "star") -> DataFrame:
    return df.groupBy(star).agg(*_with_without(answer))


def length_bin(c: str | Column) -> Column:
    """Number (0-6) of the right-closed length bin; 50 belongs to the first, 0 included."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(len(fv.LENGTH_EDGES))
    for i in reversed(range(len(fv.LENGTH_EDGES))):
        out = F.when(c <= fv.LENGTH_EDGES[i], F.lit(i)).otherwise(out)
    return F.when(c >= 0, out)


def length_bin_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in fv.LENGTH_NAMES]), number + 1)


def _all_bins(df: DataFrame, per_bin: DataFrame) -> DataFrame:
    """Every bin once, an empty one with nulls."""
    bins = df.sparkSession.range(len(fv.LENGTH_NAMES)).select(F.col("id").cast("int").alias("bin"))
    return bins.join(per_bin, "bin", "left").withColumn("length_bin", length_bin_name(F.col("bin"))).drop("bin")


def response_rate_by_length(df: DataFrame, text: str = "commentaire", answer: str = "reponse") -> DataFrame:
    binned = df.select(length_bin(tx.char_length(text)).alias("bin"), answer)
    return _all_bins(df, presence_rate(binned, "bin", answer, "response_rate", False))


def response_counts_by_length(df: DataFrame, text: str = "commentaire", answer: str = "reponse") -> DataFrame:
    counts = df.groupBy(length_bin(tx.char_length(text)).alias("bin")).agg(*_with_without(answer))
    return _all_bins(df, counts).na.fill(0, ["without_response", "with_response"])


def text_length_stats(df: DataFrame, clean_text: Column) -> DataFrame:
    """Number of non-empty cleaned texts, mean words and mean characters."""
    rows = df.select(clean_text.alias("t"))
    return rows.agg(
        F.count_if(F.col("t") != "").alias("non_empty"),
        F.round(F.avg(tx.word_count_simple("t")), 6).alias("mean_words"),
        F.round(F.avg(F.length("t")), 6).alias("mean_chars"),
    )


def length_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram between minimum and maximum; the last bin is closed, empty bins are kept."""
    rows = df.select(F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    low, high = rows.agg(F.min("_v")).scalar(), rows.agg(F.max("_v")).scalar()
    width = (high - low) / F.lit(float(bins))
    number = F.when(high == low, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("_v") - low) * F.lit(float(bins)) / (high - low)).cast("int"))
    )
    counts = rows.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin", F.round(low + F.col("bin") * width, 6).alias("lower_edge"), F.coalesce("n", F.lit(0)).alias("n")
    )


def length_by_star(df: DataFrame, text: str = "commentaire", star: str = "star") -> DataFrame:
    """Five-number summary of text length per star, missing texts left out."""
    rows = df.select(star, F.length(text).alias("_v")).filter(F.col("_v").isNotNull())
    ends = rows.groupBy(star).agg(F.count("*").alias("n"), F.min("_v").alias("min_chars"), F.max("_v").alias("max_chars"))
    both = _with_quartiles(ends, exact_quantiles(rows, "_v", QUARTILES, [star]), [star])
    return both.select(star, "n", "min_chars", *[F.round(q, 6).alias(q) for q in QUARTILES], "max_chars")


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers (the outermost values inside the fences) and the number of outliers."""
    rows = df.select(*by, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    joined = _with_quartiles(rows, exact_quantiles(rows, "_v", QUARTILES, by), by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return joined.groupBy(*by, *QUARTILES).agg(
        F.min(F.when(inside, F.col("_v"))).cast("double").alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).cast("double").alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def term_rate_by_star(df: DataFrame, term: str, text: str = "comment_clean", star: str = "star") -> DataFrame:
    """Percentage of reviews containing a term per star."""
    return df.groupBy(star).agg(F.round(100 * F.avg(tx.contains_term(text, term)), 6).alias("pct"))


def company_counts(df: DataFrame, company: str = "company") -> DataFrame:
    return value_share(df, company)


def mean_star_by_company(df: DataFrame, company: str = "company", star: str = "star") -> DataFrame:
    means = df.groupBy(company).agg(F.round(F.avg(star), 6).alias("mean_star"))
    return means.orderBy(F.desc("mean_star"), company)


def rating_matrix(df: DataFrame, company: str = "company", star: str = "star", stars: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Reviews per company and star, one column per star, 0 where there is none."""
    return df.groupBy(company).agg(*[F.count_if(F.col(star) == s).alias(f"star_{s}") for s in stars])


def star_distribution(df: DataFrame, star: str = "star") -> DataFrame:
    """Reviews per star plus a total row whose star is null."""
    rows = df.filter(F.col(star).isNotNull())
    return rows.rollup(star).agg(F.count("*").alias("n"))


def lang_distribution(df: DataFrame, lang: str = "lang") -> DataFrame:
    return value_counts(df, lang)


def lang_fr_vs_other(df: DataFrame, lang: str = "lang", target: str = "fr") -> DataFrame:
    return df.groupBy(tx.lang_group(lang, target).alias("lang_group")).agg(F.count("*").alias("n"))


def lang_non_fr(df: DataFrame, lang: str = "lang", target: str = "fr") -> DataFrame:
    return value_counts(df.filter(F.col(lang) != target), lang)

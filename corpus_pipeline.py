"""Raw documents to packed training sequences, stage by stage.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.

What a stage stores for its own use is removed when the next one starts, for its result is written by then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opinio.llm import exact_dedup, mixing, near_dedup, packing, quality
from opinio.session import remove_tables, store, stored_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []  # tables of the stage that ran last


def _tidy(stage: Stage) -> Stage:
    """The stage, after removing what the one before it left. A table that ``docs`` still reads stays: docs may be a
    result that the caller did not write."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles() if f.count("/") > 1}
            gone = [t for t in _left if t.rsplit("/", 1)[-1] not in read]
            remove_tables(spark, gone)
        kept = [t for t in _left if t in stored_tables()]
        before = set(stored_tables())
        result = stage(spark, docs, sf_dir)
        _left[:] = kept + [t for t in stored_tables() if t not in before]
        return result

    return run_stage


@_tidy
def drop_poor_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_tidy
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.drop_copies(docs)


@_tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    return near_dedup.drop_near_copies(docs)


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: not at all, once or twice."""
    return mixing.mixed_rows(docs)


@_tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, one row each."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", drop_poor_texts),
    ("exact dedup", drop_exact_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

# A trained network, hashed darts and token ids cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs

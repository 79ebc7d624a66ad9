"""Cases in which an operator once did less than its whole job."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import frame, prose
from tokenizers import Tokenizer

from opinio.llm import exact_dedup, line_dedup, mixing, near_dedup, pii, tables
from opinio.llm.tokens import Encoder, encoder


# Exact copies


def test_batches_cut_by_bytes_lose_no_row(spark):
    """Arrow batches end after a number of bytes, so scans with other columns end them at other rows."""
    rows = [(i, f"text {i % 7}") for i in range(600)]
    docs = frame(spark, rows).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4000")
    try:
        got = exact_dedup.exact_dedup(docs).collect()
        kept = exact_dedup.drop_copies(docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    sizes, last = Counter(i % 7 for i in range(600)), {i % 7: i for i in range(600)}
    assert all((r["keep_id"], r["group_size"]) == (last[r["doc_id"] % 7], sizes[r["doc_id"] % 7]) for r in got)
    assert sorted(r["doc_id"] for r in kept) == sorted(last.values())


# Row numbers


def removed(docs):
    return line_dedup.remove_repeated_runs(docs).drop("rid")


@pytest.mark.parametrize("operator", [exact_dedup.drop_copies, near_dedup.drop_near_copies, removed, pii.redact, mixing.mixed_rows])
def test_file_splits_may_change_between_scans(spark, tmp_path, monkeypatch, operator):
    """Whatever an operator stores in between, the files are split in another way the next time they are scanned."""
    rows = [(i, f"{prose(i % 30, 40)}\n+1 (212) 555-{1000 + i % 30}") for i in range(48)]
    frame(spark, rows).repartition(12).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    key = "spark.sql.files.maxPartitionBytes"
    wanted = sorted(map(str, operator(docs).collect()))

    def changing(df, name, store=tables.store):
        out = store(df, name)
        spark.conf.set(key, "6000")
        return out

    for module in (exact_dedup, near_dedup, line_dedup, pii, mixing, tables):
        monkeypatch.setattr(module, "store", changing)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        spark.conf.set(key, "1g")
        got = sorted(map(str, operator(docs).collect()))
    finally:
        for k in (key, "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.unset(k)
    assert got == wanted


# Tokens


@pytest.mark.parametrize("path, spaces", [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")])
def test_marks_after_letters_that_normalising_takes_apart(path, spaces):
    path = public_tokenizers.path(path)
    plain, pieces = Tokenizer.from_file(path), Encoder(path, spaces)
    for t in ["पहाड़, ड़.", "ALİ. ALİ", "שׁ. שׁ", "été. É! Å;"]:
        assert np.frombuffer(pieces.encode(t), dtype="<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, ascii(t)


SPECIAL = ["a <|endoftext|> b", "a<|endoftext|>.\nb", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <| x"]


@pytest.mark.parametrize("path, spaces", [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")])
def test_queries_encode_special_tokens_as_the_library_does(path, spaces):
    path = public_tokenizers.path(path)
    plain, pieces = Tokenizer.from_file(path), encoder(path, spaces)
    for t in SPECIAL:
        assert np.frombuffer(pieces.encode(t), dtype="<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t

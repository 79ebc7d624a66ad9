import os
from collections import Counter

import pandas as pd
import pytest
from test_dedup import components, jaccard
from test_rows import check_packing, targets, words

import corpus_pipeline
from opinio.llm.catalog import ORACLES, QUERIES

SF = os.environ.get("OPINIO_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, seen = docs.columns, docs.toPandas(), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.toPandas()
        seen.append((name, len(after)))
        if name != "packing":
            assert docs.columns == columns
        if name == "quality classifier":
            label = before.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
            kept = label["doc_id"].isin(after["doc_id"])
            assert (kept == (label["quality"] == 1)).mean() > 0.9
        if name == "exact dedup":
            assert sorted(after["doc_id"]) == sorted(before.groupby("text")["doc_id"].max())
        if name == "minhash near-dedup":
            rows = list(before[["doc_id", "text"]].itertuples(index=False))
            pairs = [(a, b) for k, (a, s) in enumerate(rows) for b, t in rows[:k] if min(len(s), len(t)) > 0.5 * max(len(s), len(t)) and jaccard(s, t) >= 0.8]
            assert sorted(after["doc_id"]) == sorted(set(components([r[0] for r in rows], pairs).values()))
        if name == "mixing sources":
            before["n"], after["n"] = before["text"].map(words), after["text"].map(words)
            sizes, taken = before.groupby("source")["n"].sum().to_dict(), after.groupby("source")["n"].sum().to_dict()
            want = targets(sizes)
            assert all(abs(taken.get(s, 0) - want[s]) <= before[before["source"] == s]["n"].max() for s in sizes)
            assert max(Counter(after["doc_id"]).values()) <= 2
        if name == "packing":
            check_packing(list(before[["doc_id", "text"]].itertuples(index=False)), docs.collect())
        before = after
    assert len(seen) == 5 and all(n for _, n in seen)


def test_queries_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)

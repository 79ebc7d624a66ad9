"""Every query with a SQL oracle gives the oracle's rows, columns and types on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from opinio.plans import catalog
from oracle import compare, connect

SF = os.environ.get("OPINIO_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["label"] for r in rows] == ["anglais", "roman", "allemand"]


def test_plans_have_no_all_pairs_join(spark):
    for name in ("label_totals", "tfidf", "ngram_star_distribution", "daily_outliers", "best_threshold", "value_share"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_scan_reads_only_what_it_needs(spark):
    plan = entry.queries()["star_distribution"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan

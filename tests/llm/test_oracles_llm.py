"""The operators' queries that SQL can express give its rows, columns and types on the smallest data set."""

import os

import pytest

from opinio.llm.catalog import ORACLES, QUERIES
from oracle import compare, connect

SF = os.environ.get("OPINIO_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) is None

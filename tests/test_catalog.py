"""Every catalog query against its DuckDB statement on the smallest provided tables."""

import os

import pytest
from compare import difference

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()
# The training-data operators have tests of their own, SQL or not.
OWN = {name for name in QUERIES if name == "pipeline" or name.startswith("op")}


def test_every_query_has_an_oracle():
    assert set(QUERIES) - OWN == set(ORACLE) - OWN


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OWN))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), ORACLE[name], SF_DIR) is None


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0

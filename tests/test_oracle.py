"""Every registered query against SQL on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from suite import registry
from tests.oracle import compare, connect

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == []


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "o_orderkey" and not df.isEmpty()

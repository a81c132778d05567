"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.collect() is not None
    else:
        ok, note = compare(df, con, sql)
        assert ok, note


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["item_id", "doc_id", "score", "rank"]

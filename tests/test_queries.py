"""Every registered query against its SQL twin on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, compare, connect

SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, note


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "balanced_accuracy" in df.columns


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

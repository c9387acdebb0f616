"""Every registered query against its DuckDB text over whole tables."""

import pytest
from conftest import SF_DIR
from oracle import connect, mismatch

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert mismatch(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

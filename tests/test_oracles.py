"""Every SQL-expressible query agrees with DuckDB on the small test tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duckdb_tables
from conftest import SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duckdb_tables(SMALL)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, con, name):
    assert compare(spark, con, SMALL, QUERIES[name], SQL[name]) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1500

"""Every registered query runs; those with SQL agree with it value by value."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import check


@pytest.fixture(scope="module")
def db(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, db, folder, name):
    if name in entry_points.oracle_sql():
        assert check.compare(spark, db, name, folder) == ""
    else:
        assert entry_points.queries()[name](spark, folder).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(check.entry_points.oracle.ORACLE) <= set(entry_points.queries())
    assert duckdb is check.duckdb


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0

"""Every registered query against its SQL check, over whole tables."""

import pytest
from compare import TABLES, difference, duck

import __spark_entry__ as entry_points
from vitalcells.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name], ORACLES[name], spark, FOLDER, con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert len(QUERIES[name](spark, FOLDER).take(1)) == 1


def test_entry(spark):
    assert entry_points.entry(spark).count() == 100


def test_every_check_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(TABLES) == 14

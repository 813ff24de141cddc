"""Every registered query against its SQL."""

import os

import compare
import pytest

import __spark_entry__ as entry_points
import tidemark_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = tidemark_queries.QUERIES
ORACLES = tidemark_queries.ORACLES


@pytest.fixture(scope="module")
def database():
    return compare.connect(SF_DIR)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("key", QUERIES)
def test_query(spark, database, key):
    names, found = compare.spark_rows(QUERIES[key](spark, SF_DIR))
    assert found, "no rows"
    assert len(set(names)) == len(names)
    sql_names, wanted = compare.sql_rows(database, ORACLES[key])
    assert names == sql_names
    assert found == wanted

"""Every registered query against its SQL twin on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from fareline.plans import catalog, oracle
from tests.compare import connect, spark_rows, sql_rows

SF_DIR = os.environ.get("FARELINE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    got_names, got = spark_rows(entry.queries()[name](spark, SF_DIR))
    want_names, want = sql_rows(con, entry.oracle_sql()[name])
    assert got_names == want_names
    assert len(got) == len(want)
    assert got == want
    assert got, "the fixtures should give every query something to return"

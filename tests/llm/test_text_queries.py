"""Every query of the subpackage on the given tables: against SQL where there is a twin."""

import os

import pytest

from fareline.llm import catalog
from tests.compare import connect, spark_rows, sql_rows

SF_DIR = os.environ.get("FARELINE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    names, got = spark_rows(catalog.queries()[name](spark, SF_DIR))
    want_names, want = sql_rows(connect(SF_DIR), catalog.oracle_sql()[name])
    assert names == want_names
    assert got == want
    assert got


def test_all_operators_and_the_pipeline():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.queries() if n != "pipeline")
    assert numbers == list(range(1, 14))
    assert "pipeline" in catalog.queries()

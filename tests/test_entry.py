"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["Job", "Candidate", "Similarity", "Rank"]
    assert df.count() > 0


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in entry.oracle_sql():
        assert compare(got, sql.execute(entry.oracle_sql()[name]).df()) == "ok"
    else:
        assert len(got) > 0

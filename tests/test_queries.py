import sys

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SMALL), con, entry.oracle_sql()[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["polarity_label", "rank", "term", "score"]
    assert df.count() == 30


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "pyspark" in sys.modules



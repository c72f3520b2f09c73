"""Every registered query runs; those with check SQL match it row by row."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference, spark_result, sql_result

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = spark_result(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert difference(got, sql_result(con, ORACLES[name])) is None
    else:
        assert got[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["message_key", "value", "seq"] and df.count() > 0


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

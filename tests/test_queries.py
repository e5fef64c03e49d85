"""Every registered query runs; those with a SQL twin give the same rows."""

import pytest
from oracle import connect, difference, spark_result, sql_result

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = spark_result(QUERIES[name](spark, sf_dir))
    if name in SQL:
        assert difference(got, sql_result(con, SQL[name])) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_index", "invoice_date", "invoice_id", "qty_prev", "qty_in", "price_prev", "price_new", "cmp"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)

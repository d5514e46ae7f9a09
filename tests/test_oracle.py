"""Every query with SQL gives the same values as that SQL."""

import pytest
from compare import connect, difference, duck_rows, spark_rows
from lines import SF

import __spark_entry__ as e


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query(spark, con, name):
    got = spark_rows(e.queries()[name](spark, SF))
    assert difference(got, duck_rows(con, e.oracle_sql()[name])) is None


def test_sql_belongs_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    rows = e.entry(spark).collect()
    assert rows and rows[0]["n_registros"] >= rows[-1]["n_registros"]

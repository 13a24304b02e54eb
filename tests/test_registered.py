"""Every registered query against its SQL, on the smallest tables."""

import pytest
from pyspark.sql import DataFrame

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracles import compare

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, small, name):
    _, text, ok = compare(spark, name, queries()[name], SQL.get(name), small)
    assert ok, text


def test_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert isinstance(df, DataFrame)
    assert df.columns == ["vec_id", "x", "xk"]
    assert df.count() > 0

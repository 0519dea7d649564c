"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')"
        )
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    result = db.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert got == rows_of(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["area_id", "key", "value", "expire_at"]
    assert df.count() > 0

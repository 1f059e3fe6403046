"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import rows_of
from kemptable.workload.registry import TABLES

from conftest import SMALL

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{SMALL}/{name}.parquet')")
    return connection


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 80


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    table = QUERIES[name](spark, SMALL)
    got = rows_of(table.columns, table.collect())
    if name not in SQL:
        assert got
        return
    answer = db.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(table.columns) == sorted(names)
    assert got == rows_of(names, answer.fetchall())


def test_entry(spark):
    table = contract.entry(spark)
    assert table.columns == ["column_name", "dtype", "total", "missing", "missing_rate", "samples"]
    assert table.count() == 11

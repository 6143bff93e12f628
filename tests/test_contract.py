"""The driver contract, and every query against its SQL counterpart."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of
from tallyloom.catalog.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["split", "uid", "tid", "label", "counts"] and frame.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    frame = contract.queries()[name](spark, sf)
    mine = frame.collect()
    assert mine
    if name in contract.oracle_sql():
        cursor = db.execute(contract.oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(frame.columns) == sorted(columns)
        assert rows_of(frame.columns, mine) == rows_of(columns, cursor.fetchall())

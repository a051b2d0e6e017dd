"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal
from tests.conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    expected = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert normal(got) == normal(expected)


def test_entry(spark):
    rows = entry.entry(spark)
    assert len(rows.columns) == 55 and rows.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)

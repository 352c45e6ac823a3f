"""Every query against its SQL on the smallest data, and basic contracts."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from rolloom.plans.base import TABLES
from tools.check_oracle import compare


@pytest.fixture(scope="module")
def connection(data):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, connection, data, name):
    status, note, _ = compare(spark, connection, name, data)
    assert status in ("ok", "rows"), note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0

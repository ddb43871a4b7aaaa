"""Registered queries against their SQL on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner.plans.registry import QUERIES
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, detail = compare(spark, con, name, FOLDER)
    assert status in ("OK", "ROWS"), detail


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

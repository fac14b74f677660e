"""Queries with SQL against that SQL, over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from dayrank.llm.catalog import QUERIES, SQL
from tests.conftest import SF
from tests.llm.helpers import TABLES, assert_same


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    assert assert_same(QUERIES[name](spark, SF), duck.sql(SQL[name])) > 0

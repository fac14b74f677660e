"""Every query against its SQL, over the whole sf0.01 tables."""

from __future__ import annotations

import duckdb
import pytest

from checks.oracle import oracle_sql
from dayrank.plans.catalog import catalog
from tests.compare import assert_same
from tests.conftest import SF

QUERIES = catalog()
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("events", "part"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_but_the_models_own_ranking_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"gbt_rank"}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    assert assert_same(QUERIES[name](spark, SF), duck.sql(ORACLE[name])) > 0

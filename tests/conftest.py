from __future__ import annotations

import sys
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from dayrank.schema import PREPARED_LOG  # noqa: E402
from dayrank.session import tune  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("dayrank-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = tune(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_log(spark):
    """A prepared log out of (user, item, category, behaviour, day, hour) rows."""

    def make(rows: list[tuple[int, int, int, int, date, int]]) -> DataFrame:
        data = [
            (u, i, b, c, f"{d:%Y-%m-%d} {h}", h, d) for u, i, c, b, d, h in rows
        ]
        return spark.createDataFrame(data, PREPARED_LOG)

    return make


def days_back(day: date, n: int) -> date:
    return day - timedelta(days=n)


def parse(text: str) -> date:
    return datetime.strptime(text, "%Y-%m-%d").date()

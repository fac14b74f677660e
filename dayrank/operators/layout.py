"""The rollup laid out by user on storage, so that blocks and samples meet without being moved.

The table has one partition per day, and within a day one bucket per hash of the user. Pairs, users and
users with categories are all counted, rolled and joined inside their user's bucket: a scan that reads
buckets counts as hash-partitioned by user, so none of that needs an exchange. The layout is paid once,
when the rollup is written, and serves every table computed from it.

A user is in one bucket, so users with a large share of the rows are kept apart, as are rows without a
user: they are few keys, and go the general way, where hot keys are spread.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.operators.skew import measured_keys
from dayrank.session import fresh_path, materialize, own_table

CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def joined_as_they_lie(spark: SparkSession) -> Iterator[None]:
    """Plan joins on (label day, user, ...) of rows that lie by user alone without moving them. Only for
    what is executed inside the block: elsewhere the usual rule keeps salted joins apart."""
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)


@dataclass(frozen=True)
class ByUser:
    """A rollup in two tables that share no user."""

    #: Bucketed by user, partitioned by day.
    bucketed: DataFrame
    #: Rows of hot users and of none, partitioned by day.
    rest: DataFrame
    has_hot: bool

    @property
    def whole(self) -> DataFrame:
        return self.bucketed.unionByName(self.rest)


def by_user(rollup: DataFrame, cfg: FeatureConfig, buckets: int | None = None) -> ByUser:
    """Write a rollup by day and user. ``rollup`` is read three times: hand in one from storage."""
    spark = rollup.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = measured_keys(rollup, [("user_id",)], cfg)[("user_id",)][1]
    apart = F.col("user_id").isNull()
    if hot is not None:
        rollup = rollup.join(F.broadcast(hot.withColumnRenamed("copies", "__hot")), "user_id", "left")
        apart = apart | F.col("__hot").isNotNull()
    columns = [c for c in rollup.columns if c != "__hot"]
    path, name = fresh_path(spark, "by-user"), f"by_user_{uuid.uuid4().hex}"
    (
        rollup.filter(~apart)
        .select(*columns)
        # One writer a bucket: a bucket is one file a day.
        .repartition(buckets, "user_id")
        .write.partitionBy("day")
        .bucketBy(buckets, "user_id")
        .sortBy("user_id", "item_id")
        .option("path", path)
        .saveAsTable(name)
    )
    own_table(name, path)
    rest = materialize(rollup.filter(apart).select(*columns), "by-user-rest", "day")
    return ByUser(spark.table(name).select(*columns), rest.select(*columns), hot is not None)

"""A generated behaviour log with hot keys, and a timed run over it.

``python -m checks.skewed_log [rows]`` prints seconds of the steps of a feature table over a log in
which one user and one item each hold a third of the rows, and how even the tasks of its last
shuffle are.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.operators.rollup import base_rollup
from dayrank.plans.features import train_features
from dayrank.schema import PREPARED_LOG
from dayrank.session import materialize, tune
from dayrank.sources.warehouse import EVENTS_CONFIG

FIRST_DAY, DAYS = "2024-01-01", 30


def skewed_log(spark: SparkSession, rows: int) -> DataFrame:
    """User 1 and item 1 in a third of the rows each, the rest spread over as many users and items
    as there are hundreds of rows, all in one category. Repeats exactly."""
    spread = max(10, rows // 100)

    def pick(seed: int, n: int):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))

    hot = pick(0, 3)
    frame = spark.range(0, rows, 1, 16).select(
        F.when(hot == 0, 1).otherwise(pick(1, spread) + 2).alias("user_id"),
        F.when(hot == 1, 1).otherwise(pick(2, spread) + 2).alias("item_id"),
        (pick(3, 4) + 1).cast("int").alias("behavior_type"),
        pick(4, 24).cast("int").alias("hour"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), pick(5, DAYS).cast("int")).alias("day"),
    )
    return frame.filter(~F.col("day").isin(*EVENTS_CONFIG.gap_days)).select(
        "user_id",
        "item_id",
        "behavior_type",
        F.lit(7).cast("long").alias("item_category"),
        F.concat_ws(" ", F.col("day").cast("string"), F.lpad(F.col("hour").cast("string"), 2, F.lit("0"))).alias("time"),
        "hour",
        "day",
    ).select(*PREPARED_LOG.fieldNames())


def task_rows(frame: DataFrame) -> list[int]:
    """Rows of each partition of a frame that has any."""
    counted = frame.groupBy(F.spark_partition_id()).count().collect()
    return sorted(r["count"] for r in counted)


def main(rows: int = 3_700_000) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("dayrank-skew")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "64")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    cfg = FeatureConfig(
        last_label_day=EVENTS_CONFIG.last_label_day, gap_days=EVENTS_CONFIG.gap_days, hot_rows=1000
    )
    began = time.perf_counter()
    rollup = materialize(base_rollup(skewed_log(spark, rows)), "rollup", "day")
    print(f"rollup of {rows} rows: {time.perf_counter() - began:.0f} s")
    began = time.perf_counter()
    features = materialize(train_features(rollup, cfg), "features")
    print(f"{features.count()} samples with all features: {time.perf_counter() - began:.0f} s")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    sizes = task_rows(train_features(rollup, cfg).select("user_id", "item_id", "uc_long_b1"))
    print(f"rows of a task: mean {sum(sizes) / len(sizes):.0f}, most {sizes[-1]}, {len(sizes)} tasks")
    spark.stop()


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))

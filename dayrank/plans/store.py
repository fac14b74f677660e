"""Stored tables that are kept up by day: rollup, user sketches and training features.

A store is a folder with three Parquet tables. ``rollup`` and ``sketches`` have one partition for each log
day, ``features`` one for each label day. A new or redelivered log day is counted by itself and
replaces its partitions; the label days whose windows or labels see it are computed anew and replace
theirs. Nothing else is read or written, so a day costs its own windows and not the whole calendar.

Replacing is Spark's dynamic partition overwrite: partitions that are written are replaced, others stay.
It replaces nothing where a day has no rows any more, so such partitions are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayrank.config import FeatureConfig
from dayrank.operators.distinct_sketches import user_sketches
from dayrank.operators.label_calendar import TRAIN, LabelDay, label_day, label_days
from dayrank.operators.rollup import base_rollup
from dayrank.plans.features import named, train_rows
from dayrank.schema import USER_ITEM, features_schema
from dayrank.session import exists, file_names, remove

#: Tasks, and files, that a label day's small features are spread over.
PIECES = 16

ROLLUP_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("item_category", T.LongType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("behavior_type", T.IntegerType()),
    T.StructField("cnt", T.LongType()),
    T.StructField("day", T.DateType()),
])
SKETCHES_SCHEMA = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("behavior_type", T.IntegerType()),
    T.StructField("users", T.BinaryType()),
    T.StructField("day", T.DateType()),
])


def rollup_table(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(ROLLUP_SCHEMA).parquet(f"{store}/rollup")


def sketches_table(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(SKETCHES_SCHEMA).parquet(f"{store}/sketches")


def features_table(spark: SparkSession, store: str, cfg: FeatureConfig) -> DataFrame:
    """The stored training features, with their columns in order."""
    schema = features_schema(True, cfg.sub_windows, cfg.extras)
    return spark.read.schema(schema).parquet(f"{store}/features").select(*schema.fieldNames())


def stored_label_days(spark: SparkSession, store: str) -> list[date]:
    """The label days a store holds, none if there is no store."""
    if not exists(spark, f"{store}/features"):
        return []
    days = spark.read.schema("label_day date").parquet(f"{store}/features").distinct()
    return sorted(r["label_day"] for r in days.collect())


def _replace(
    frame: DataFrame,
    path: str,
    by: str,
    values: Iterable[date],
    spread_by: Sequence[str] = (),
    finished: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> None:
    """Make the partitions of ``values`` hold the frame's rows, and no others change. The frame does not
    read what is replaced.

    It is computed and written in one go; a value that has rows has none of its former files after that.
    Rows are gathered and sorted by value first and ``finished`` then, so that columns which follow from
    others are neither moved nor sorted. With ``spread_by`` a value goes to ``PIECES`` tasks at most as
    long as these stay below the advisory size, each a file of its own.
    """
    spark = frame.sparkSession
    former = {at: file_names(spark, at) for at in {f"{path}/{by}={v.isoformat()}" for v in values}}
    piece = F.pmod(F.xxhash64(*spread_by), F.lit(PIECES)) if spread_by else F.lit(0)
    gathered = frame.withColumn("__piece", piece).hint("rebalance", by, "__piece")
    placed = gathered.sortWithinPartitions(by).drop("__piece")
    finished(placed).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        by
    ).parquet(path)
    for at, names in former.items():
        if names & file_names(spark, at):
            remove(spark, at)


def put_log_days(store: str, log: DataFrame, days: Sequence[date], cfg: FeatureConfig) -> None:
    """Count these days of a prepared log and replace their rollup and sketches. Of a log partitioned
    by day only their files are read."""
    spark = log.sparkSession
    days = sorted(set(days))
    if not days:
        return
    rollup = base_rollup(log.filter(F.col("day").isin(*days))).select(*ROLLUP_SCHEMA.fieldNames())
    _replace(rollup, f"{store}/rollup", "day", days)
    counted = rollup_table(spark, store).filter(F.col("day").isin(*days))
    _replace(
        user_sketches(counted, cfg).select(*SKETCHES_SCHEMA.fieldNames()), f"{store}/sketches", "day", days
    )


def put_label_days(spark: SparkSession, store: str, days: Sequence[LabelDay], cfg: FeatureConfig) -> None:
    """Compute these label days from the stored counts and replace their features. The days of their
    windows are read, and no others."""
    if not days:
        return
    sketches = sketches_table(spark, store) if cfg.approximate_users else None
    _replace(
        train_rows(rollup_table(spark, store), cfg, days, sketches),
        f"{store}/features",
        "label_day",
        [d.label_day for d in days],
        spread_by=USER_ITEM.keys,
        finished=lambda rows: named(rows, cfg, labelled=True),
    )


def drop_label_days(spark: SparkSession, store: str, days: Iterable[date]) -> None:
    """Remove label days, for instance those that fall out of a calendar that moves on."""
    for day in days:
        remove(spark, f"{store}/features/label_day={day.isoformat()}")


def touched_label_days(cfg: FeatureConfig, log_days: Iterable[date]) -> list[LabelDay]:
    """The label days of the calendar that see any of these log days, in a window or for their label."""
    changed = set(log_days)
    return [
        d
        for d in label_days(cfg, TRAIN)
        if any(d.long_from <= x <= d.long_to or x == d.label_day for x in changed)
    ]


def update(
    store: str, log: DataFrame, log_days: Sequence[date], cfg: FeatureConfig, known: Iterable[date] = ()
) -> list[date]:
    """Bring a store up to ``cfg``'s calendar after these log days arrived or changed.

    Counted anew are the log days; computed anew are the label days that see them, and those of the
    calendar that are not among ``known``, the label days the store holds; removed are known ones that are
    no longer in the calendar. Gives the label days that were computed.
    """
    spark = log.sparkSession
    put_log_days(store, log, log_days, cfg)
    wanted = [d.label_day for d in label_days(cfg, TRAIN)]
    touched = {d.label_day for d in touched_label_days(cfg, log_days)}
    todo = [label_day(d, cfg) for d in wanted if d in touched or d not in set(known)]
    put_label_days(spark, store, todo, cfg)
    drop_label_days(spark, store, set(known) - set(wanted))
    return [d.label_day for d in todo]


def window_days(days: Sequence[LabelDay]) -> list[date]:
    """All log days that label days need."""
    found = set()
    for d in days:
        found |= {d.long_from + timedelta(days=k) for k in range((d.label_day - d.long_from).days + 1)}
    return sorted(found)

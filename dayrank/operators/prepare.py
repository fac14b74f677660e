"""Raw log to prepared log, and the row-level slices of the prepared log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.functions import day_of, hour_of
from dayrank.operators.label_calendar import (
    LabelDay,
    last_days_table,
    membership,
    within_days,
)
from dayrank.operators.skew import lookup_join
from dayrank.schema import PURCHASE


def prepare_log(raw: DataFrame, items: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Keep the log of the listed items, split its time into day and hour, drop gap days."""
    parsed = raw.withColumn("day", day_of(F.col("time"))).withColumn("hour", hour_of(F.col("time")))
    kept = parsed.filter(~F.col("day").isin(*cfg.gap_days)) if cfg.gap_days else parsed
    wanted = items.select("item_id")
    return lookup_join(kept, wanted, "item_id", ["user_id", "time"], cfg, "left_semi")


def one_day_slice(log: DataFrame, days: Sequence[LabelDay], cfg: FeatureConfig) -> DataFrame:
    """The log rows of each label day's sample day."""
    table = last_days_table(log.sparkSession, days, cfg, 1)
    return within_days(log, days).join(F.broadcast(table), "day")


def long_window(log: DataFrame, days: Sequence[LabelDay], cfg: FeatureConfig) -> DataFrame:
    """The log rows of each label day's long window."""
    table = membership(log.sparkSession, days, cfg).select("day", "label_day")
    return within_days(log, days).join(F.broadcast(table), "day")


def purchases(log: DataFrame) -> DataFrame:
    return log.filter(F.col("behavior_type") == PURCHASE)

"""Distinct users per item and behaviour in each label day's long window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.operators.label_calendar import LabelDay, membership
from dayrank.schema import BEHAVIOURS, Entity


def next_active_days(pairs: DataFrame, reach: int) -> list:
    """For each behaviour, the next day within reach on which the pair shows it again."""
    ahead = (
        Window.partitionBy("user_id", "item_id").orderBy("day_no").rangeBetween(1, reach)
    )
    return [
        F.min(F.when(F.col(f"n{b}") > 0, F.col("day"))).over(ahead).alias(f"next{b}")
        for b in BEHAVIOURS
    ]


def unique_users(
    pairs: DataFrame, entity: Entity, days: Sequence[LabelDay], cfg: FeatureConfig
) -> DataFrame:
    """Exact distinct users, without a distinct over (label day, item, user).

    ``pairs`` holds one row per user, item and day. A user counts for a window once, at the
    last active day inside it: the day whose next active day lies after the window or does not
    exist. A row without a user counts no one, but keeps its item. So rows can first be counted per (item, behaviour, day, next day), a small histogram
    that combines on the map side, and only that is spread over the label days. A hot item's
    users never meet in one task.

    A category column in ``pairs`` goes along as far as the histogram. Reading the same columns
    as the sample frame lets both use one shuffle of the pairs, the largest of a feature table.
    """
    reach = max(d.long_back for d in days) + 1
    marked = pairs.withColumn("day_no", F.unix_date("day"))
    item = [c for c in ("item_id", "item_category") if c in pairs.columns]
    marked = marked.select("user_id", *item, "day", *(f"n{b}" for b in BEHAVIOURS),
                           *next_active_days(marked, reach))
    active = marked.select(
        "user_id",
        *item,
        "day",
        F.explode(F.array(*(
            F.when(F.col(f"n{b}") > 0, F.struct(F.lit(b).alias("b"), F.col(f"next{b}").alias("next")))
            for b in BEHAVIOURS
        ))).alias("act"),
    ).filter(F.col("act").isNotNull())
    histogram = active.groupBy(*item, "day", "act.b", "act.next").agg(
        F.count("user_id").alias("users")
    )
    table = membership(pairs.sparkSession, days, cfg).select("day", "label_day", "long_to")
    return (
        histogram.join(F.broadcast(table), "day")
        .filter(F.col("next").isNull() | (F.col("next") > F.col("long_to")))
        .groupBy("label_day", "item_id")
        .agg(*(
            F.sum(F.when(F.col("b") == b, F.col("users")).otherwise(0)).alias(
                f"{entity.prefix}_uniq_b{b}"
            )
            for b in BEHAVIOURS
        ))
    )

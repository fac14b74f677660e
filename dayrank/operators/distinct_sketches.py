"""Distinct users per item as sketches that are kept by day and merged by window.

The exact count needs every (user, item) pair of the windows again. A sketch (HyperLogLog) of the
users of an item, behaviour and day is a few dozen bytes while users are few and 2 ** lg_k x 3/4 bytes at
most, and the union of the sketches of a window's days is the sketch of the window's users. So sketches
are counted once when a day arrives, stored beside the rollup, and a window costs their union. The
relative standard error of an estimate is 1.04 / 2 ** (lg_k / 2); few users are counted
without error. Partial sketches are merged within a task before the shuffle, so a hot item's users
never meet in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.operators.label_calendar import LabelDay, membership, within_days
from dayrank.schema import BEHAVIOURS, ITEM, Entity


def relative_error(lg_k: int) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / 2 ** (lg_k / 2)


def user_sketches(log: DataFrame, cfg: FeatureConfig, entity: Entity = ITEM) -> DataFrame:
    """One row per key, behaviour and day of a log or rollup, with the sketch of its users. Rows without
    a user keep their key and add no one; rows without a key are left out."""
    (key,) = entity.keys
    return (
        log.filter(F.col(key).isNotNull())
        .groupBy(key, "behavior_type", "day")
        .agg(F.hll_sketch_agg("user_id", cfg.sketch_lg_k).alias("users"))
    )


def _estimate(b: int) -> Column:
    own = F.when(F.col("behavior_type") == b, F.col("users"))
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(own)), F.lit(0)).cast("long")


def estimated_users(
    sketches: DataFrame, days: Sequence[LabelDay], cfg: FeatureConfig, entity: Entity = ITEM
) -> DataFrame:
    """Estimated distinct users per behaviour in each label day's long window, with the columns of the
    exact count."""
    table = membership(sketches.sparkSession, days, cfg).select("day", "label_day")
    return (
        within_days(sketches, days)
        .filter(F.col("behavior_type").isin(*BEHAVIOURS))
        .join(F.broadcast(table), "day")
        .groupBy("label_day", *entity.keys)
        .agg(*(_estimate(b).alias(f"{entity.prefix}_uniq_b{b}") for b in BEHAVIOURS))
    )


def compare(
    exact: DataFrame, estimated: DataFrame, cfg: FeatureConfig, deviations: float = 4, entity: Entity = ITEM
) -> DataFrame:
    """For each label day and behaviour: keys with users, their exact users in all, and how many keys have
    an estimate further off than so many standard errors (and one user), or are on one side only."""
    on = ["label_day", *entity.keys]
    names = [f"{entity.prefix}_uniq_b{b}" for b in BEHAVIOURS]
    both = exact.select(*on, *names, F.lit(1).alias("has_exact")).join(
        estimated.select(*on, *(F.col(c).alias(f"est_{c}") for c in names), F.lit(1).alias("has_estimate")),
        on,
        "full",
    )
    bound = deviations * relative_error(cfg.sketch_lg_k)
    each = F.explode(F.array(*(
        F.struct(F.lit(b).alias("behaviour"), F.col(c).alias("users"), F.col(f"est_{c}").alias("estimate"))
        for b, c in zip(BEHAVIOURS, names, strict=True)
    )))
    missing = F.col("has_exact").isNull() | F.col("has_estimate").isNull()
    off = F.abs(F.col("x.estimate") - F.col("x.users")) > F.greatest(F.lit(1.0), F.col("x.users") * bound)
    return (
        both.select("label_day", missing.alias("missing"), each.alias("x"))
        .groupBy("label_day", F.col("x.behaviour").alias("behaviour"))
        .agg(
            F.count_if(F.col("x.users") > 0).alias("n_items"),
            F.coalesce(F.sum("x.users"), F.lit(0)).alias("users"),
            F.count_if(F.col("missing") | F.coalesce(off, F.lit(True))).alias("n_beyond"),
        )
    )

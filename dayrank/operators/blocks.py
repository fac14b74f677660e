"""Entity blocks: every key active in a label day's long window, with its features.

The daily rows of a key already share a partition, so spreading a day over the (at most
nine) label days that see it and summing per label day needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.functions import CELL, N_CELLS, aliased, averages, profile, ratios
from dayrank.operators.label_calendar import LabelDay, last_days_table, membership, within_days
from dayrank.operators.rollup import (
    daily_counts,
    entity_cells,
    entity_days,
)
from dayrank.operators.uniques import unique_users
from dayrank.schema import (
    BEHAVIOURS,
    ITEM,
    USER_ITEM,
    Entity,
    block_columns,
    profile_columns,
)


def _with_label_days(daily: DataFrame, days: Sequence[LabelDay], cfg: FeatureConfig) -> DataFrame:
    table = membership(daily.sparkSession, days, cfg)
    return daily.join(F.broadcast(table), "day")


def _when(flag: str | None, value: Column) -> Column:
    return value if flag is None else F.when(F.col(flag), value)


def _sums(stem: str, flag: str | None) -> list[Column]:
    return [
        F.coalesce(F.sum(_when(flag, F.col(f"n{b}"))), F.lit(0)).alias(f"{stem}_b{b}")
        for b in BEHAVIOURS
    ]


def window_counts(
    rollup: DataFrame,
    entity: Entity,
    window: str,
    days: Sequence[LabelDay],
    cfg: FeatureConfig,
) -> DataFrame:
    """Counts per behaviour over one window (``long``, ``d1`` or ``d<n>``) for the keys active
    in it."""
    daily = _with_label_days(
        daily_counts(within_days(rollup, days), entity.keys), days, cfg
    )
    if window != "long":
        daily = daily.filter(F.col(f"in_{window}"))
    return daily.groupBy("label_day", *entity.keys).agg(
        *_sums(f"{entity.prefix}_{window}", None)
    )


def window_averages(counts: DataFrame, entity: Entity, cfg: FeatureConfig) -> DataFrame:
    p = entity.prefix
    found = averages(f"{p}_long", f"{p}_avg", cfg.slot)
    return counts.selectExpr("label_day", *entity.keys, *aliased(found))


def window_ratios(counts: DataFrame, entity: Entity, window: str) -> DataFrame:
    """Actions per purchase over a window; the long window's are features, the sub-windows'
    are extras named after their window."""
    p = entity.prefix
    out = f"{p}_ratio" if window == "long" else f"{p}_{window}_ratio"
    found = ratios(f"{p}_{window}", out)
    return counts.selectExpr("label_day", *entity.keys, *aliased(found))


def one_day_extremes(
    rollup: DataFrame, entity: Entity, days: Sequence[LabelDay], cfg: FeatureConfig
) -> DataFrame:
    """First and last hour, their distance, and the strongest behaviour on the sample day."""
    p = entity.prefix
    table = last_days_table(rollup.sparkSession, days, cfg, 1)
    found = (
        within_days(rollup, days)
        .join(F.broadcast(table), "day")
        .groupBy("label_day", *entity.keys)
        .agg(
            F.min("hour").alias(f"{p}_hour_min"),
            F.max("hour").alias(f"{p}_hour_max"),
            F.max("behavior_type").alias(f"{p}_type_max"),
        )
    )
    return found.withColumn(f"{p}_hour_range", F.col(f"{p}_hour_max") - F.col(f"{p}_hour_min"))


def hour_profile(
    rollup: DataFrame,
    entity: Entity,
    days: Sequence[LabelDay],
    cfg: FeatureConfig,
    n: int = 1,
) -> DataFrame:
    """Counts per hour and behaviour over the last n days, all 96 cells, per active key."""
    table = last_days_table(rollup.sparkSession, days, cfg, n)
    wanted = F.broadcast(table.select("day").distinct())
    cells = entity_cells(within_days(rollup, days).join(wanted, "day", "left_semi"), entity)
    found = (
        cells.join(F.broadcast(table), "day")
        .withColumn("cell", F.expr(CELL))
        .groupBy("label_day", *entity.keys)
        .pivot("cell", list(range(N_CELLS)))
        .agg(F.sum("cnt"))
    )
    stem = entity.profile if n == 1 else f"{entity.profile}{n}d"
    names = {name: f"coalesce(`{i}`, 0L)" for i, name in enumerate(profile_columns(stem))}
    return found.selectExpr("label_day", *entity.keys, *aliased(names))


def live_days(
    rollup: DataFrame, entity: Entity, days: Sequence[LabelDay], cfg: FeatureConfig
) -> DataFrame:
    """Number of days with each behaviour in the long window."""
    daily = _with_label_days(daily_counts(within_days(rollup, days), entity.keys), days, cfg)
    return daily.groupBy("label_day", *entity.keys).agg(*_live(entity))


def _live(entity: Entity) -> list[Column]:
    return [F.count_if(F.col(f"n{b}") > 0).alias(f"{entity.live}_days_b{b}") for b in BEHAVIOURS]


def touch_span(
    rollup: DataFrame, entity: Entity, days: Sequence[LabelDay], cfg: FeatureConfig
) -> DataFrame:
    """Days from the first to the last touch in the long window."""
    active = within_days(rollup, days).select(*entity.keys, "day").distinct()
    return (
        _with_label_days(active.repartition(*entity.keys), days, cfg)
        .groupBy("label_day", *entity.keys)
        .agg(F.date_diff(F.max("day"), F.min("day")).alias(f"{entity.prefix}_span"))
    )


def entity_block(
    rollup: DataFrame, entity: Entity, days: Sequence[LabelDay], cfg: FeatureConfig
) -> DataFrame:
    """The entity's whole block: one row per label day and key active in the long window."""
    p = entity.prefix
    rollup = within_days(rollup, days)
    daily = _with_label_days(entity_days(rollup, entity, days), days, cfg)
    aggs = _sums(f"{p}_long", None) + _sums(f"{p}_d1", "in_d1")
    for n in cfg.sub_windows:
        aggs += _sums(f"{p}_d{n}", f"in_d{n}")
    for name in ("hour_min", "hour_max") if entity.hours else ():
        aggs.append(F.max(_when("in_d1", F.col(name))).alias(f"{p}_{name}"))
    if entity.type_max:
        aggs.append(F.max(_when("in_d1", F.col("type_max"))).alias(f"{p}_type_max"))
    if entity.live:
        aggs += _live(entity)
    if entity.profile:
        # At most one row of a key and label day is the sample day's.
        aggs.append(F.collect_list(_when("in_d1", F.col("cells"))).alias("cells"))
    block = daily.groupBy("label_day", *entity.keys).agg(*aggs)
    if entity.profile:
        block = block.withColumn("cells", F.map_from_entries(F.get("cells", 0)))
    if entity.unique_users:
        pairs = daily_counts(rollup, USER_ITEM.keys)
        block = block.join(
            unique_users(pairs, ITEM, days, cfg), ["label_day", *entity.keys], "left"
        )
    return _finished(block, entity, cfg)


def _finished(block: DataFrame, entity: Entity, cfg: FeatureConfig) -> DataFrame:
    """The block's columns in order: what follows from its counts added, its profile expanded,
    nulls filled with 0."""
    p = entity.prefix
    derived: dict[str, str] = {}
    if entity.rates:
        derived |= averages(f"{p}_long", f"{p}_avg", cfg.slot)
        derived |= ratios(f"{p}_long", f"{p}_ratio")
    if "range" in entity.hours:
        derived[f"{p}_hour_range"] = f"{p}_hour_max - {p}_hour_min"
    if entity.profile:
        derived |= profile("cells", entity.profile)
    features = {
        c: f"coalesce({derived.get(c, c)}, 0)" for c in block_columns(entity, cfg.sub_windows)
    }
    return block.selectExpr("label_day", *entity.keys, *aliased(features))

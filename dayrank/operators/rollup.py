"""Pre-aggregation: everything later reads counts, never raw rows.

Each step combines on the map side before it shuffles, and its group key keeps day, hour and
behaviour. So after the first step one entity key owns at most days x 24 x 4 rows, however
many log rows it had; only then are an entity's rows brought together by its key.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrank.functions import CELL
from dayrank.operators.label_calendar import LabelDay
from dayrank.schema import BEHAVIOURS, Entity

GRAIN = ("day", "hour", "behavior_type")


def base_rollup(log: DataFrame) -> DataFrame:
    """Log rows counted per user, item, category, day, hour and behaviour."""
    return log.groupBy("user_id", "item_id", "item_category", *GRAIN).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def unit_rollup(log: DataFrame) -> DataFrame:
    """Log rows as a rollup of ones, for a job that reads them for one block only: the block's
    own first aggregation then combines them, and the base rollup's shuffle is saved."""
    return log.withColumn("cnt", F.lit(1).cast("long"))


def cell_rollup(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rollup counted per entity key, day, hour and behaviour."""
    return rollup.groupBy(*keys, *GRAIN).agg(F.sum("cnt").alias("cnt"))


def _counts() -> list:
    return [
        F.sum(F.when(F.col("behavior_type") == b, F.col("cnt")).otherwise(0)).alias(f"n{b}")
        for b in BEHAVIOURS
    ]


def is_pair(keys: Sequence[str]) -> bool:
    return {"user_id", "item_id"} <= set(keys)


def daily_counts(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per behaviour of each key and day, with a key's days in one partition.

    For user-item pairs ``rollup`` is the base rollup, which is already near this grain: it is
    moved once and summed in place. Other keys are combined first and moved then.
    """
    if is_pair(keys):
        return rollup.repartition(*keys).groupBy(*keys, "day").agg(*_counts())
    return rollup.groupBy(*keys, "day").agg(*_counts()).repartition(*keys)


def entity_cells(rollup: DataFrame, entity: Entity, placed: bool = False) -> DataFrame:
    """Counts per key, day, hour and behaviour, with a key's rows in one partition. A rollup that is
    ``placed`` has its users' rows together already and is not moved."""
    keys = entity.keys
    if placed and not is_pair(keys):
        return cell_rollup(rollup, keys)
    if is_pair(keys):
        return (rollup if placed else rollup.repartition(*keys)).groupBy(*keys, *GRAIN).agg(
            F.sum("cnt").alias("cnt"), F.min("item_category").alias("item_category")
        )
    return cell_rollup(rollup, keys).repartition(*keys)


def daily_profile(
    cells: DataFrame,
    entity: Entity,
    days: Sequence[LabelDay],
    sample_behaviours=None,
    profile_days: int = 1,
) -> DataFrame:
    """One row per key and day: behaviour counts, first and last hour, strongest behaviour
    and, on the last ``profile_days`` days up to a sample day, the cell counts as a list of at most
    96 (cell, cnt) entries.

    Keeping the hour profile sparse until the last projection keeps shuffled rows short: a
    pair touched twice in a day carries two entries and not 96 columns.
    """
    wanted = {d.sample_day - timedelta(days=k) for d in days for k in range(profile_days)}
    on_sample_day = F.col("day").isin(*sorted(wanted))
    cell = F.expr(CELL)
    aggs = [
        *_counts(),
        F.min("hour").alias("hour_min"),
        F.max("hour").alias("hour_max"),
        F.max("behavior_type").alias("type_max"),
        F.collect_list(
            F.when(on_sample_day & cell.isNotNull(), F.struct(cell.alias("cell"), "cnt"))
        ).alias("cells"),
    ]
    if "item_category" in cells.columns and "item_category" not in entity.keys:
        category = F.col("item_category")
        if sample_behaviours:
            category = F.when(F.col("behavior_type").isin(*sample_behaviours), category)
        aggs.append(F.min(category).alias("item_category"))
    return cells.groupBy(*entity.keys, "day").agg(*aggs)


def entity_days(
    rollup: DataFrame, entity: Entity, days: Sequence[LabelDay], sample_behaviours=None
) -> DataFrame:
    """Daily rows of an entity, partitioned by its key, as both block builders read them."""
    if entity.profile is None:
        return daily_counts(rollup, entity.keys)
    return daily_profile(entity_cells(rollup, entity), entity, days, sample_behaviours)

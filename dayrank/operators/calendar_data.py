"""The label calendar as a stored table, for calendars that are not known while planning.

Where the configuration gives the calendar its dates are literals in the plan. Where a table does,
say of several runs or of label days chosen elsewhere, the plan only knows that log days meet the
calendar's days. The log, stored by day, is then pruned while the query runs: the calendar's days are
broadcast, the scan of the log takes the same broadcast as a filter on its partitions, and opens only
the files of days that are in a window (dynamic partition pruning).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.functions import literal_table
from dayrank.operators.label_calendar import LabelDay
from dayrank.operators.rollup import daily_counts
from dayrank.schema import BEHAVIOURS, PURCHASE, SAMPLE_KEY, WITH_IDS, Entity


def calendar_rows(
    spark: SparkSession, run: str, days: Sequence[LabelDay], cfg: FeatureConfig
) -> DataFrame:
    """One row per label day of a run: its windows and the gap days they leave out. Written to storage,
    runs side by side, this is the table the functions below read."""
    subs = sorted(days[0].sub_from)
    columns = ["label_day", "sample_day", "long_from", "long_to", *(f"d{n}_from" for n in subs)]
    rows = [
        (d.label_day, d.sample_day, d.long_from, d.long_to, *(d.sub_from[n] for n in subs)) for d in days
    ]
    gap = F.array(*(F.lit(g) for g in cfg.gap_days)) if cfg.gap_days else F.array().cast("array<date>")
    table = literal_table(spark, columns, rows)
    return table.select(F.lit(run).alias("run"), "*", gap.alias("gap_days"))


def window_days(calendar: DataFrame) -> DataFrame:
    """One row per log day and label day whose long window holds it, flagged with the shorter windows."""
    subs = [c for c in calendar.columns if c.startswith("d") and c.endswith("_from")]
    return (
        calendar.withColumn("day", F.explode(F.sequence("long_from", "long_to")))
        .filter(~F.array_contains("gap_days", F.col("day")))
        .select(
            "day",
            "label_day",
            (F.col("day") == F.col("sample_day")).alias("in_d1"),
            *((F.col("day") >= F.col(c)).alias(f"in_{c.removesuffix('_from')}") for c in subs),
        )
    )


def long_window(log: DataFrame, calendar: DataFrame) -> DataFrame:
    """The log rows of each label day's long window."""
    return log.join(F.broadcast(window_days(calendar).select("day", "label_day")), "day")


def window_counts(rollup: DataFrame, entity: Entity, window: str, calendar: DataFrame) -> DataFrame:
    """Counts per behaviour over one window for the keys active in it. Days are pruned before they are
    counted, and met with their label days after."""
    flags = window_days(calendar)
    needed = flags.select("day").distinct()
    daily = daily_counts(rollup.join(F.broadcast(needed), "day", "left_semi"), entity.keys)
    seen = daily.join(F.broadcast(flags), "day")
    if window != "long":
        seen = seen.filter(F.col(f"in_{window}"))
    return seen.groupBy("label_day", *entity.keys).agg(
        *(F.sum(f"n{b}").alias(f"{entity.prefix}_{window}_b{b}") for b in BEHAVIOURS)
    )


def samples(log: DataFrame, calendar: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Labelled samples: a day gives samples to one label day and labels to another."""
    roles = calendar.select(
        "label_day",
        F.explode(F.array(
            F.struct(F.col("sample_day").alias("day"), F.lit(True).alias("is_sample")),
            F.struct(F.col("label_day").alias("day"), F.lit(False).alias("is_sample")),
        )).alias("role"),
    ).select("label_day", "role.*")
    touched = F.col("is_sample")
    if cfg.sample_behaviours:
        touched = touched & F.col("behavior_type").isin(*cfg.sample_behaviours)
    bought = ~F.col("is_sample") & (F.col("behavior_type") == PURCHASE)
    return (
        log.filter(WITH_IDS)
        .join(F.broadcast(roles), "day")
        .filter(touched | bought)
        .groupBy(*SAMPLE_KEY)
        .agg(
            F.max(touched).alias("touched"),
            F.min(F.when(touched, F.col("item_category"))).alias("item_category"),
            F.max(bought).cast("int").alias("label"),
        )
        .filter("touched")
        .drop("touched")
    )

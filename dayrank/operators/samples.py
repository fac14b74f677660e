"""Training and score samples with their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.operators.label_calendar import LabelDay, role_table, within_days
from dayrank.schema import PURCHASE, SAMPLE_KEY, WITH_IDS


def samples(
    log: DataFrame, days: Sequence[LabelDay], cfg: FeatureConfig, labelled: bool
) -> DataFrame:
    """Distinct (user, item) pairs touched on each sample day, with the label if wanted.

    A log day gives samples to one label day and labels to another. Both roles go through the
    same aggregation, so labelling is part of the deduplication and needs no join. Where a pair
    has several categories the smallest is kept.
    """
    table = role_table(log.sparkSession, days, labelled)
    touched = F.col("is_sample")
    if cfg.sample_behaviours:
        touched = touched & F.col("behavior_type").isin(*cfg.sample_behaviours)
    bought = ~F.col("is_sample") & (F.col("behavior_type") == PURCHASE)
    found = (
        within_days(log, days)
        .filter(WITH_IDS)
        .join(F.broadcast(table), "day")
        .filter(touched | bought)
        .groupBy(*SAMPLE_KEY)
        .agg(
            F.max(touched).alias("touched"),
            F.min(F.when(touched, F.col("item_category"))).alias("item_category"),
            F.max(bought).cast("int").alias("label"),
        )
        .filter("touched")
    )
    return found.select(*SAMPLE_KEY, "item_category", *(["label"] if labelled else []))


def samples_per_day(frame: DataFrame) -> DataFrame:
    return frame.groupBy("label_day").agg(F.count(F.lit(1)).alias("samples"))

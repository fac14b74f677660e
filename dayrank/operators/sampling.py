"""Repeatable downsampling of negatives: to an exact count, or each with the same chance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.schema import SAMPLE_KEY

#: Hex digits of the hash that each counting step looks at: 16**4 = 65,536 buckets.
STEP = 4


#: Hex digits that make a uniform number; 16**13 numbers are exact in a double.
DIGITS = 13


def _digest(cfg: FeatureConfig) -> Column:
    """A seeded hash of a sample's key."""
    key = [F.col(k).cast("string") for k in SAMPLE_KEY]
    return F.md5(F.concat_ws("|", *key, F.lit(cfg.seed)))


def downsample(frame: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """All positives and exactly min(negatives, ratio x positives) negatives.

    Negatives are taken in the order of a seeded hash of their key, so the choice does not
    depend on partitioning or row order. ``frame`` is unique on its key and comes from storage:
    finding the cut reads its key and label several times.
    """
    return frame.filter(chosen(frame.select(*SAMPLE_KEY, "label"), cfg))


def chosen(labels: DataFrame, cfg: FeatureConfig) -> Column:
    """The predicate that keeps all positives and the negatives up to the cut.

    ``labels`` holds key and label of every sample. The cut, the hash of the last negative taken,
    is found now and without sorting the negatives: they are counted per hash prefix, the running
    count names the prefix in which the last one falls, and the same is done once more inside it.
    Each count gives at most 65,536 rows, and what is finally ordered is one in 16**8 of the
    negatives. Only single rows reach the driver.
    """
    digest = _digest(cfg)
    positive = F.col("label") == 1
    totals = labels.agg(
        F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives")
    ).first()
    need = totals["positives"] * cfg.negatives_per_positive
    if need >= totals["negatives"]:
        return F.lit(True)
    if need == 0:
        return positive

    inside = labels.filter(~positive).select(digest.alias("digest"))
    for digits in (STEP, 2 * STEP):
        counted = inside.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(
            F.count(F.lit(1)).alias("n")
        )
        upto = F.sum("n").over(Window.orderBy("prefix"))
        cut = (
            counted.select("prefix", "n", upto.alias("upto"))
            .filter(F.col("upto") >= need)
            .orderBy("prefix")
            .first()
        )
        need -= cut["upto"] - cut["n"]
        inside = inside.filter(F.col("digest").startswith(cut["prefix"]))
    last = inside.orderBy("digest").limit(need).agg(F.max("digest").alias("last")).first()
    return positive | (digest <= last["last"])


def class_fractions(labels: DataFrame, cfg: FeatureConfig) -> dict[int, float]:
    """The chance of each class: all positives, and of the negatives as many as are wanted for them."""
    positive = F.col("label") == 1
    totals = labels.agg(
        F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives")
    ).first()
    need = totals["positives"] * cfg.negatives_per_positive
    return {1: 1.0, 0: min(1.0, need / totals["negatives"]) if totals["negatives"] else 1.0}


def drawn(fractions: Mapping[int, float], cfg: FeatureConfig) -> Column:
    """Whether a row is drawn: its seeded hash, as a number from 0 to 1, is below its class's chance. It
    depends on the row's key alone, not on partitions, the order of rows or a retry."""
    uniform = F.conv(F.substring(_digest(cfg), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))
    chance = F.lit(0.0)
    for label, fraction in fractions.items():
        chance = F.when(F.col("label") == label, F.lit(float(fraction))).otherwise(chance)
    return uniform < chance


def bernoulli(
    frame: DataFrame, cfg: FeatureConfig, fractions: Mapping[int, float] | None = None
) -> DataFrame:
    """A stratified Bernoulli sample with a ``weight``: how many rows of its class a drawn row stands for,
    so that a class's weights add up to its rows.

    With ``fractions`` given, drawing is one pass without any count before it; else classes are counted
    first. The weights come from one more count over keys and labels: rows over drawn rows. A class
    of which no row was drawn has no weights. Nothing is sorted or shuffled but two counts.
    """
    labels = frame.select(*SAMPLE_KEY, "label")
    fractions = class_fractions(labels, cfg) if fractions is None else fractions
    keep = drawn(fractions, cfg)
    return weighted(frame.filter(keep), class_weights(labels, keep))


def class_weights(labels: DataFrame, keep: Column) -> dict[int, float]:
    """Rows of each class by its drawn rows."""
    counts = (
        labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(keep).alias("drawn")).collect()
    )
    return {r["label"]: r["n"] / r["drawn"] for r in counts if r["drawn"]}


def weighted(frame: DataFrame, weights: Mapping[int, float]) -> DataFrame:
    weight = F.lit(None).cast("double")
    for label, value in weights.items():
        weight = F.when(F.col("label") == label, F.lit(float(value))).otherwise(weight)
    return frame.withColumn("weight", weight)

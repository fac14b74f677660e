"""Precision, recall and F1 of predicted pairs against the purchases of the next day."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayrank.operators.prepare import purchases
from dayrank.operators.ranking import before_parts, ranges
from dayrank.session import materialize

PAIR = ("user_id", "item_id")


def actual_pairs(log: DataFrame, as_of: date) -> DataFrame:
    """All pairs bought on the day after ``as_of``, whether they were candidates or not."""
    next_day = as_of + timedelta(days=1)
    return purchases(log.filter(F.col("day") == F.lit(next_day))).select(*PAIR).distinct()


def best_per_pair(predicted: DataFrame) -> DataFrame:
    """Each predicted pair once, with its best score."""
    return predicted.groupBy(*PAIR).agg(F.max("prob").alias("prob"))


def evaluate(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """One row of metrics. Predictions and purchases are tagged, unioned and counted per pair,
    which deduplicates both sides and finds the matches in one aggregation."""
    tagged = predicted.select(*PAIR, F.lit(1).alias("p"), F.lit(0).alias("a")).unionByName(
        actual.select(*PAIR, F.lit(0).alias("p"), F.lit(1).alias("a"))
    )
    pairs = tagged.groupBy(*PAIR).agg(F.max("p").alias("p"), F.max("a").alias("a"))
    counts = pairs.agg(
        F.coalesce(F.sum((F.col("p") * F.col("a")).cast("long")), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.col("p").cast("long")), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.col("a").cast("long")), F.lit(0)).alias("actual"),
    )
    rates = counts.select("tp", "predicted", "actual", *_rates("predicted"))
    return rates.select(_f_score().alias("f_score"), "precision", "recall", "tp", "predicted", "actual")


def _rates(predicted: str) -> list[Column]:
    tp = F.col("tp").cast("double")
    return [
        F.try_divide(tp, F.col(predicted).cast("double")).alias("precision"),
        F.try_divide(tp, F.col("actual").cast("double")).alias("recall"),
    ]


def _f_score() -> Column:
    return F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))


def evaluate_every_k(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the best K pairs for every K, with the pair that K adds.

    Each predicted pair takes part once, with its best score. Predictions are matched first, in one
    aggregation with the purchases, then ranked as a whole in ranges; true positives are added
    up within each range, and to that come those of the ranges before. So it is one sort, and no task holds
    more than a range.
    """
    tagged = predicted.select(*PAIR, "prob", F.lit(1).alias("p"), F.lit(0).alias("hit")).unionByName(
        actual.select(*PAIR, F.lit(None).cast("double").alias("prob"), F.lit(0).alias("p"), F.lit(1).alias("hit"))
    )
    pairs = tagged.groupBy(*PAIR).agg(
        F.max("prob").alias("prob"), F.max("p").alias("p"), F.max("hit").cast("long").alias("hit")
    )
    pairs = materialize(pairs, "matched")
    bought = pairs.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("actual")).first()["actual"]
    # A prediction without a score comes last.
    order = [F.desc("prob"), *(F.asc(c) for c in PAIR)]
    table = ranges(pairs.filter("p = 1"), order, "evaluated")
    sums = table.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("hit").alias("hits"))
    upto = Window.partitionBy("part").orderBy("in_part")
    counted = (
        table.withColumn("hits", F.sum("hit").over(upto))
        .join(F.broadcast(before_parts(sums, "rows", "hits")), "part")
        .select(
            *PAIR,
            "prob",
            (F.col("rows_before") + F.col("in_part") + 1).alias("k"),
            (F.col("hits_before") + F.col("hits")).alias("tp"),
            F.lit(bought).cast("long").alias("actual"),
        )
    )
    return counted.select("*", *_rates("k")).withColumn("f_score", _f_score())

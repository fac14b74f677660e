"""Ranking by score and cutting to the best K."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayrank.schema import SAMPLE_KEY
from dayrank.session import materialize


def top_k(
    scored: DataFrame, k: int, score: str = "prob", ties: Sequence[str] = ("user_id", "item_id")
) -> DataFrame:
    """The k best rows, best first; equal scores in the order of ``ties``.

    Sort and limit together let every task keep its own best k, so nothing is sorted whole.
    """
    return scored.orderBy(F.desc(score), *ties).limit(k)


#: Low bits of a row's number within the sort; the bits above are its partition.
ROW_BITS = 33


def ranges(frame: DataFrame, order: Sequence[Column], name: str = "ranking") -> DataFrame:
    """The rows sorted as a whole and written as ranges of that order, with ``part`` and ``in_part``, the
    range and the place within it from 0 on.

    The order tells all rows apart, so that many rows of one score fill several ranges. ``frame`` is read
    twice, first to find the ranges: hand in one from storage.
    """
    number = F.monotonically_increasing_id()
    placed = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__number", number)
    table = materialize(placed, name)
    return table.select(
        *frame.columns,
        F.shiftright("__number", ROW_BITS).alias("part"),
        F.col("__number").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("in_part"),
    )


def before_parts(per_part: DataFrame, *counts: str) -> DataFrame:
    """For each range what the ranges before it hold of each count. One row a range."""
    window = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "part", *(F.coalesce(F.sum(c).over(window), F.lit(0)).alias(f"{c}_before") for c in counts)
    )


def whole_ranking(
    scored: DataFrame, score: str = "prob", ties: Sequence[str] = ("user_id", "item_id")
) -> DataFrame:
    """All rows with their ``rank`` from 1 on: a row's place in its range and the sizes of the ranges
    before. No task holds more than a range; what is summed up in one is one row a range."""
    table = ranges(scored, [F.desc(score), *(F.asc(t) for t in ties)])
    sizes = table.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    return table.join(F.broadcast(before_parts(sizes, "rows")), "part").select(
        *scored.columns, (F.col("rows_before") + F.col("in_part") + 1).alias("rank")
    )


def activity_score() -> Column:
    """A whole-number score that repeats exactly: weighted sample-day behaviours of the pair
    and the user's purchases. Stands in for a model's probability where results must be
    comparable."""
    weighted = sum((F.col(f"ui_d1_b{b}") * b for b in (1, 2, 3, 4)), F.lit(0))
    return (weighted * 10 + F.col("u_long_b4")).cast("double")


def with_activity_score(features: DataFrame) -> DataFrame:
    return features.select(*SAMPLE_KEY, activity_score().alias("prob"))

"""Label days and their look-back windows.

The calendar is a function of the configuration alone (15 rows for training, one for
scoring), so its dates are literals in the plan: they reach the scan as partition filters,
and the tables below are broadcast with a known size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.functions import literal_table

TRAIN = "train"
SCORE = "score"


@dataclass(frozen=True)
class LabelDay:
    """One label day with its sample day, inclusive long window and sub-window starts."""

    label_day: date
    sample_day: date
    long_from: date
    long_to: date
    sub_from: dict[int, date]

    def back(self, start: date) -> int:
        """Days from a window's start to the sample day."""
        return (self.sample_day - start).days

    @property
    def long_back(self) -> int:
        return self.back(self.long_from)


def _days(n: int) -> timedelta:
    return timedelta(days=n)


def _label_day(label: date, cfg: FeatureConfig, as_of: str) -> LabelDay:
    gap = len(cfg.gap_days)
    if as_of == TRAIN:
        sample = label - _days(1)
        inside = sum(label - _days(cfg.slot) < g < label for g in cfg.gap_days)
        long_from = label - _days(cfg.slot - 1 + inside)
    else:
        sample = label
        long_from = label - _days(cfg.slot - 2)
    widen = gap if label - _days(cfg.widen_probe) in cfg.gap_days else 0
    return LabelDay(
        label,
        sample,
        long_from,
        sample,
        {n: max(long_from, label - _days(n + widen)) for n in cfg.sub_windows},
    )


def label_days(cfg: FeatureConfig, as_of: str) -> list[LabelDay]:
    """Training walks back from the last label day over days that neither are nor follow a
    gap day; scoring has the last label day alone."""
    if as_of == SCORE:
        return [_label_day(cfg.last_label_day, cfg, as_of)]
    if as_of != TRAIN:
        raise ValueError(f"as_of must be {TRAIN!r} or {SCORE!r}, not {as_of!r}")
    found: list[LabelDay] = []
    day = cfg.last_label_day
    while len(found) < cfg.n_label_days:
        if day not in cfg.gap_days and day - _days(1) not in cfg.gap_days:
            found.append(_label_day(day, cfg, as_of))
        day -= _days(1)
    return found


def label_day(day: date, cfg: FeatureConfig) -> LabelDay:
    """A single training label day with its windows."""
    return _label_day(day, cfg, TRAIN)


def day_range(days: Sequence[LabelDay]) -> tuple[date, date]:
    """First and last log day that any window or label needs."""
    return min(d.long_from for d in days), max(d.label_day for d in days)


def within_days(log: DataFrame, days: Sequence[LabelDay]) -> DataFrame:
    """Keep the log days the windows need, as a filter that prunes day partitions."""
    first, last = day_range(days)
    return log.filter(F.col("day").between(F.lit(first), F.lit(last)))


def spine(spark: SparkSession, days: Sequence[LabelDay]) -> DataFrame:
    """One row per label day with the dates of its windows."""
    subs = sorted(days[0].sub_from, reverse=True)
    return literal_table(
        spark,
        ["label_day", "sample_day", "long_from", "long_to", *(f"d{n}_from" for n in subs)],
        [
            (d.label_day, d.sample_day, d.long_from, d.long_to, *(d.sub_from[n] for n in subs))
            for d in days
        ],
    )


def sample_day_table(spark: SparkSession, days: Sequence[LabelDay]) -> DataFrame:
    """``day`` (the sample day) -> ``label_day`` and how far back its windows reach."""
    subs = sorted(days[0].sub_from)
    return literal_table(
        spark,
        ["day", "label_day", "long_back", *(f"d{n}_back" for n in subs)],
        [
            (d.sample_day, d.label_day, d.long_back, *(d.back(d.sub_from[n]) for n in subs))
            for d in days
        ],
    )


def membership(spark: SparkSession, days: Sequence[LabelDay], cfg: FeatureConfig) -> DataFrame:
    """One row per (log day, label day whose long window holds it) with window flags.

    Joining on ``day`` replaces a range join against the spine by a hash join; the table has
    at most ``n_label_days`` x window length rows.
    """
    subs = sorted(days[0].sub_from)
    rows = []
    for d in days:
        for back in range(d.long_back + 1):
            day = d.sample_day - _days(back)
            if day in cfg.gap_days:
                continue
            flags = tuple(day >= d.sub_from[n] for n in subs)
            rows.append((day, d.label_day, d.long_to, back == 0, *flags))
    return literal_table(
        spark, ["day", "label_day", "long_to", "in_d1", *(f"in_d{n}" for n in subs)], rows
    )


def last_days_table(
    spark: SparkSession, days: Sequence[LabelDay], cfg: FeatureConfig, n: int
) -> DataFrame:
    """``day`` -> ``label_day`` for the n calendar days before each label day; for n = 1 the
    sample day itself."""
    rows = []
    for d in days:
        wanted = [d.sample_day] if n == 1 else [d.label_day - _days(k) for k in range(1, n + 1)]
        rows += [(day, d.label_day) for day in wanted if day not in cfg.gap_days]
    return literal_table(spark, ["day", "label_day"], rows)


def role_table(spark: SparkSession, days: Sequence[LabelDay], labelled: bool) -> DataFrame:
    """``day`` -> the label days it gives samples to and, in training, labels to."""
    rows = [(d.sample_day, d.label_day, True) for d in days]
    if labelled:
        rows += [(d.label_day, d.label_day, False) for d in days]
    return literal_table(spark, ["day", "label_day", "is_sample"], rows)

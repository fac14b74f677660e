"""The label-day schedule, written out by hand for December and for the generated events."""

from __future__ import annotations

from datetime import date, timedelta

import pytest

from dayrank.config import FeatureConfig
from dayrank.operators.label_calendar import SCORE, TRAIN, label_days, membership
from dayrank.sources.warehouse import EVENTS_CONFIG

# label day, sample day, first and last long day, days with data, then the starts of the
# 3-, 5- and 7-day windows with their days with data.
SCHEDULE = [
    ("12-18", "12-17", "12-07", "12-17", 9, ("12-15", 3), ("12-13", 5), ("12-11", 5)),
    ("12-17", "12-16", "12-06", "12-16", 9, ("12-12", 4), ("12-10", 5), ("12-08", 7)),
    ("12-16", "12-15", "12-05", "12-15", 9, ("12-11", 3), ("12-09", 5), ("12-07", 7)),
    ("12-15", "12-14", "12-04", "12-14", 9, ("12-12", 2), ("12-10", 3), ("12-08", 5)),
    ("12-14", "12-13", "12-03", "12-13", 9, ("12-11", 1), ("12-09", 3), ("12-07", 5)),
    ("12-10", "12-09", "12-01", "12-09", 9, ("12-07", 3), ("12-05", 5), ("12-03", 7)),
    ("12-09", "12-08", "11-30", "12-08", 9, ("12-06", 3), ("12-04", 5), ("12-02", 7)),
]
SCORE_ROW = ("12-18", "12-18", "12-10", "12-18", 7, ("12-15", 4), ("12-13", 6), ("12-11", 6))


def plain_row(back: int):
    """The label days before the gap's reach, all alike."""
    day = date(2014, 12, 8) - timedelta(days=back)

    def at(n: int) -> str:
        return f"{day - timedelta(days=n):%m-%d}"

    return (at(0), at(1), at(9), at(1), 9, (at(3), 3), (at(5), 5), (at(7), 7))


ALL_TRAIN = SCHEDULE + [plain_row(k) for k in range(8)]


def as_row(day, gap_days):
    def data_days(start):
        span = (day.long_to - start).days + 1
        return sum(start + timedelta(days=k) not in gap_days for k in range(span))

    def fmt(value):
        return f"{value:%m-%d}"

    return (
        fmt(day.label_day), fmt(day.sample_day), fmt(day.long_from), fmt(day.long_to),
        data_days(day.long_from),
        *((fmt(day.sub_from[n]), data_days(day.sub_from[n])) for n in (3, 5, 7)),
    )


def test_train_schedule():
    cfg = FeatureConfig()
    assert [as_row(d, cfg.gap_days) for d in label_days(cfg, TRAIN)] == ALL_TRAIN


def test_score_schedule():
    cfg = FeatureConfig()
    assert [as_row(d, cfg.gap_days) for d in label_days(cfg, SCORE)] == [SCORE_ROW]


def test_events_schedule_is_the_same_shifted():
    shift = EVENTS_CONFIG.last_label_day - FeatureConfig().last_label_day
    for as_of in (TRAIN, SCORE):
        for ours, other in zip(label_days(FeatureConfig(), as_of), label_days(EVENTS_CONFIG, as_of)):
            assert ours.label_day + shift == other.label_day
            assert ours.long_from + shift == other.long_from
            assert {n: d + shift for n, d in ours.sub_from.items()} == other.sub_from


def test_unknown_view_is_refused():
    with pytest.raises(ValueError):
        label_days(FeatureConfig(), "both")


def test_no_gap_days():
    days = label_days(FeatureConfig(gap_days=()), TRAIN)
    assert len(days) == 15
    assert all((a.label_day - b.label_day).days == 1 for a, b in zip(days, days[1:]))
    assert {d.long_back for d in days} == {8}


def test_membership_is_bounded_and_leaves_out_gap_days(spark):
    cfg = FeatureConfig()
    rows = membership(spark, label_days(cfg, TRAIN), cfg).collect()
    assert len(rows) == 15 * 9
    assert not {r["day"] for r in rows} & set(cfg.gap_days)
    assert sum(r["in_d1"] for r in rows) == 15

"""Small logs whose results can be read off."""

from __future__ import annotations

from datetime import date, timedelta

import pytest

from dayrank.functions import add_purchase_flag
from dayrank.operators.blocks import window_counts, window_ratios
from dayrank.operators.evaluate import actual_pairs, best_per_pair, evaluate
from dayrank.operators.label_calendar import SCORE, TRAIN, label_days
from dayrank.operators.prepare import prepare_log
from dayrank.operators.ranking import top_k
from dayrank.operators.rollup import base_rollup
from dayrank.operators.samples import samples
from dayrank.plans.features import score_features, train_features
from dayrank.schema import ITEMS, RAW_LOG, USER, feature_columns, features_schema
from dayrank.sources.warehouse import EVENTS_CONFIG as CFG

L = date(2024, 1, 20)
SAMPLE = L - timedelta(days=1)
TRAIN_DAYS = label_days(CFG, TRAIN)


def of_label_day(frame, day=L):
    return [r.asDict() for r in frame.collect() if r["label_day"] == day]


def test_window_sizes_with_one_event_per_day(make_log):
    first = date(2024, 1, 1)
    days = [first + timedelta(days=k) for k in range(30)]
    rows = [(1, 1, 1, 1, d, 5) for d in days if d not in CFG.gap_days]
    found = {}
    for window in ("long", "d5", "d3", "d7"):
        counted = window_counts(base_rollup(make_log(rows)), USER, window, TRAIN_DAYS, CFG)
        found[window] = {
            str(r["label_day"])[-2:]: r[f"u_{window}_b1"] for r in counted.collect()
        }
    assert set(found["long"].values()) == {9}
    assert [found["d3"][d] for d in ("30", "29", "28", "27", "26", "22")] == [3, 4, 3, 2, 1, 3]
    assert [found["d5"][d] for d in ("30", "29", "28", "27", "26", "22")] == [5, 5, 5, 3, 3, 5]
    assert [found["d7"][d] for d in ("30", "29", "28", "27", "26", "22")] == [5, 7, 7, 5, 5, 7]


def test_score_windows_hold_one_day_more(make_log):
    rows = [(1, 1, 1, 1, date(2024, 1, 1) + timedelta(days=k), 5) for k in range(30)]
    rows = [r for r in rows if r[4] not in CFG.gap_days]
    (row,) = score_features(base_rollup(make_log(rows)), CFG).collect()
    assert [row[f"u_{w}_b1"] for w in ("long", "d1", "d3", "d5", "d7")] == [7, 1, 4, 6, 6]
    assert row["ulive_days_b1"] == 7 and row["u_avg_b1"] == pytest.approx(0.7)


def test_ratio_without_purchases_is_zero(make_log):
    rows = [(1, 1, 1, 1, SAMPLE, 3)] * 5 + [(2, 1, 1, 2, SAMPLE, 3)]
    rows += [(3, 1, 1, 1, SAMPLE, 3)] * 5 + [(3, 1, 1, 4, SAMPLE, 3)] * 2
    counts = window_counts(base_rollup(make_log(rows)), USER, "long", TRAIN_DAYS, CFG)
    found = {r["user_id"]: r for r in of_label_day(window_ratios(counts, USER, "long"))}
    assert [found[u]["u_ratio_click"] for u in (1, 2, 3)] == [0.0, 0.0, 2.5]
    assert found[2]["u_ratio_skim"] == 0.0


def test_pairs_with_equal_quotient_are_told_apart(make_log):
    log = make_log([(2, 4, 1, 1, SAMPLE, 0), (1, 2, 1, 4, L, 0), (5, 5, 1, 1, SAMPLE, 0),
                    (5, 5, 1, 4, L, 1)])
    labels = {(r["user_id"], r["item_id"]): r["label"]
              for r in of_label_day(samples(log, TRAIN_DAYS, CFG, True))}
    assert labels == {(2, 4): 0, (5, 5): 1}


def test_repeated_touches_make_one_sample_with_the_smallest_category(make_log):
    log = make_log([(1, 1, c, 1, SAMPLE, 0) for c in (9, 7, 8)])
    (row,) = of_label_day(samples(log, TRAIN_DAYS, CFG, True))
    assert row["item_category"] == 7


def test_first_and_last_hour(make_log):
    log = make_log([(1, 1, 1, 1, SAMPLE, 0), (1, 1, 1, 3, SAMPLE, 23)])
    (row,) = of_label_day(train_features(base_rollup(log), CFG))
    assert (row["u_hour_min"], row["u_hour_max"], row["u_hour_range"]) == (0, 23, 23)
    assert (row["ui_hour_min"], row["ui_hour_max"], row["ui_type_max"]) == (0, 23, 3)
    assert row["uih_h00_b1"] == 1 and row["uih_h23_b3"] == 1
    assert sum(v for k, v in row.items() if k.startswith("uih_")) == 2


def test_label_day_without_purchases(make_log):
    log = make_log([(1, 1, 1, 1, SAMPLE, 0), (2, 1, 1, 2, SAMPLE, 0)])
    found = of_label_day(train_features(base_rollup(log), CFG))
    assert [r["label"] for r in found] == [0, 0]
    assert {r[c] for r in found for c in feature_columns() if "_ratio_" in c} == {0.0}


def test_purchase_the_day_after_the_gap_is_no_label(make_log):
    """The day after the gap has no sample day, so it is no label day."""
    log = make_log([(1, 1, 1, 1, date(2024, 1, 22), 0), (1, 1, 1, 4, date(2024, 1, 25), 0)])
    assert samples(log, TRAIN_DAYS, CFG, True).filter("label = 1").count() == 0


def test_empty_log(spark, make_log):
    rollup = base_rollup(make_log([]))
    assert train_features(rollup, CFG).count() == 0
    assert score_features(rollup, CFG).count() == 0


def test_feature_list():
    names = feature_columns()
    assert len(names) == len(set(names)) == 426
    trained, scored = features_schema(True), features_schema(False)
    assert trained.fieldNames()[5:] == scored.fieldNames()[4:] == names


def test_prepare(spark):
    raw = spark.createDataFrame(
        [(1, 1, 1, 7, "2024-01-22 00"), (1, 1, 4, 7, "2024-01-23 05"),
         (1, 2, 1, 7, "2024-01-25 23"), (1, 3, 1, 7, "2024-01-25 09")],
        RAW_LOG,
    )
    items = spark.createDataFrame([(1,), (3,), (3,), (8,)], ITEMS)
    found = prepare_log(raw, items, CFG).orderBy("day").collect()
    assert [(r["item_id"], str(r["day"]), r["hour"]) for r in found] == [
        (1, "2024-01-22", 0), (3, "2024-01-25", 9)
    ]


def test_purchase_flag_accumulates(spark, make_log):
    log = make_log([(1, 1, 1, 4, SAMPLE, 0), (1, 2, 1, 1, SAMPLE, 0)]).select("item_id", "behavior_type")
    once = add_purchase_flag(log)
    twice = add_purchase_flag(once)
    assert {r["item_id"]: r["build_label"] for r in once.collect()} == {1: 1, 2: 0}
    assert {r["item_id"]: r["build_label"] for r in twice.collect()} == {1: 2, 2: 0}


def test_top_k_breaks_ties_by_id(spark):
    scored = spark.createDataFrame(
        [(2, 1, 0.5), (1, 2, 0.5), (1, 1, 0.5), (9, 9, 0.9)], "user_id long, item_id long, prob double"
    )
    found = [(r["user_id"], r["item_id"]) for r in top_k(scored, 3).collect()]
    assert found == [(9, 9), (1, 1), (1, 2)]
    assert top_k(scored, 100).count() == 4


def test_evaluation(spark, make_log):
    log = make_log([(1, 1, 1, 4, L, 0), (1, 1, 1, 4, L, 1), (2, 2, 1, 4, L, 0), (3, 3, 1, 1, L, 0)])
    predicted = spark.createDataFrame(
        [(1, 1, 0.9), (1, 1, 0.3), (3, 3, 0.8), (4, 4, 0.1), (5, 5, 0.1)],
        "user_id long, item_id long, prob double",
    )
    deduplicated = best_per_pair(predicted)
    assert {tuple(r) for r in deduplicated.collect()} >= {(1, 1, 0.9)}
    (row,) = evaluate(predicted, actual_pairs(log, SAMPLE)).collect()
    assert (row["tp"], row["predicted"], row["actual"]) == (1, 4, 2)
    assert (row["precision"], row["recall"]) == (0.25, 0.5)
    assert row["f_score"] == pytest.approx(1 / 3)


def test_evaluation_without_a_match(spark, make_log):
    log = make_log([(1, 1, 1, 4, L, 0)])
    predicted = spark.createDataFrame([(7, 7, 0.5)], "user_id long, item_id long, prob double")
    (row,) = evaluate(predicted, actual_pairs(log, SAMPLE)).collect()
    assert (row["tp"], row["precision"], row["recall"], row["f_score"]) == (0, 0.0, 0.0, None)


def test_evaluation_with_nothing_predicted(spark, make_log):
    predicted = spark.createDataFrame([], "user_id long, item_id long, prob double")
    (row,) = evaluate(predicted, actual_pairs(make_log([]), SAMPLE)).collect()
    assert tuple(row) == (None, None, None, 0, 0, 0)


def test_score_days_follow_the_config():
    (day,) = label_days(CFG, SCORE)
    assert day.sample_day == day.long_to == CFG.last_label_day

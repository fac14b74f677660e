"""Stored tables kept up by day, and calendars and layouts that come from storage."""

from __future__ import annotations

import os
import random
import re
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from dayrank.operators import calendar_data
from dayrank.operators.calendar_data import calendar_rows
from dayrank.operators.label_calendar import SCORE, TRAIN, label_days
from dayrank.operators.layout import CO_PARTITION, by_user, joined_as_they_lie
from dayrank.operators.prepare import long_window
from dayrank.operators.rollup import base_rollup
from dayrank.operators.samples import samples
from dayrank.plans import jobs
from dayrank.plans.features import score_features, train_features
from dayrank.plans.placed import placed_samples, placed_score_features, placed_train_features
from dayrank.plans.store import (
    PIECES,
    features_table,
    put_label_days,
    put_log_days,
    rollup_table,
    touched_label_days,
    update,
    window_days,
)
from dayrank.schema import USER_CATEGORY, USER_ITEM
from dayrank.session import exists, fresh_path, materialize, shared_folder, temporary_tables
from dayrank.sources import behaviour as io
from dayrank.sources.warehouse import EVENTS_CONFIG as CFG
from tests.test_plans import plan_of

DAYS = label_days(CFG, TRAIN)


@pytest.fixture(scope="module")
def log(spark):
    """A small random log with hot users, rows without users, and hours and behaviours out of range."""
    rng = random.Random(21)
    rows = []
    for _ in range(2500):
        user = rng.choice([1, 1, 1, 2, *range(3, 30), None])
        item = rng.choice([1, 1, *range(2, 40), None])
        day = date(2024, 1, 1) + timedelta(days=rng.randrange(31))
        if day in CFG.gap_days:
            continue
        hour = rng.choice([*range(24), 30])
        rows.append((user, item, rng.choice([1, 1, 2, 3, 4, 4, 9]), (item or 0) % 6, f"{day} {hour:02d}", hour, day))
    frame = spark.createDataFrame(
        rows, "user_id long, item_id long, behavior_type int, item_category long, time string, hour int, day date"
    )
    return materialize(frame, "prepared", "day")


def rows_of(frame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(repr(tuple(r)) for r in frame.select(*columns).collect())


@pytest.fixture(scope="module")
def rollup(log):
    return materialize(base_rollup(log), "rollup", "day")


@pytest.fixture(scope="module")
def full(rollup):
    return rows_of(train_features(rollup, CFG))


def test_days_added_one_by_one_equal_the_full_run(spark, log, full):
    path = fresh_path(spark, "store")
    before = replace(CFG, last_label_day=DAYS[2].label_day)
    counted = window_days(label_days(before, TRAIN))
    known = update(path, log, counted, before)
    assert sorted(known) == sorted(d.label_day for d in label_days(before, TRAIN))
    for d in reversed(DAYS[:2]):
        now = replace(CFG, last_label_day=d.label_day)
        new = [x for x in window_days(label_days(now, TRAIN)) if x not in counted]
        computed = update(path, log, new, now, known)
        assert computed == [d.label_day]
        counted, known = counted + new, [x.label_day for x in label_days(now, TRAIN)]
    # The calendar moved on by two days, so the two oldest label days are gone.
    assert rows_of(features_table(spark, path, CFG)) == full


def test_a_day_that_changes_recomputes_the_label_days_that_see_it(spark, log, full):
    path = fresh_path(spark, "store")
    changed = date(2024, 1, 20)
    other = log.filter((F.col("day") != F.lit(changed)) | (F.col("behavior_type") != 1))
    known = update(path, other, window_days(DAYS), CFG)
    assert rows_of(features_table(spark, path, CFG)) != full
    again = update(path, log, [changed], CFG, known)
    assert set(again) == {d.label_day for d in DAYS if d.long_from <= changed <= d.label_day}
    assert 0 < len(again) < len(DAYS)
    assert rows_of(features_table(spark, path, CFG)) == full


def test_only_the_windows_of_a_label_day_are_read(spark, log):
    path = fresh_path(spark, "store")
    put_log_days(path, log, window_days(DAYS), CFG)
    newest = DAYS[0]
    plan = plan_of(train_features(rollup_table(spark, path), CFG, [newest]))
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert scans
    for s in scans:
        assert f">= {newest.long_from}" in s and f"<= {newest.label_day}" in s or f"= {newest.sample_day}" in s


def test_a_day_without_rows_is_emptied(spark, log):
    path = fresh_path(spark, "store")
    day = date(2024, 1, 21)
    put_log_days(path, log, window_days(DAYS), CFG)
    assert rollup_table(spark, path).filter(F.col("day") == F.lit(day)).count() > 0
    others = rows_of(rollup_table(spark, path).filter(F.col("day") != F.lit(day)))
    put_log_days(path, log.filter(F.col("day") != F.lit(day)), [day], CFG)
    assert rows_of(rollup_table(spark, path)) == others
    assert not exists(spark, f"{path}/rollup/day={day}")
    touched = touched_label_days(CFG, [day])
    put_label_days(spark, path, touched, CFG)
    sampled = {d.label_day for d in touched if d.sample_day == day}
    found = {r.label_day for r in features_table(spark, path, CFG).select("label_day").distinct().collect()}
    assert sampled and not sampled & found


def test_features_of_a_store_are_written_once(spark, log, full):
    """No table beside the store: features are computed and written in one go."""
    path = fresh_path(spark, "store")
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    known = update(path, log, window_days(DAYS), CFG)
    update(path, log, [DAYS[0].long_from], CFG, known)
    assert set(os.listdir(folder)) - before == {path.rsplit("/", 1)[1]}
    assert rows_of(features_table(spark, path, CFG)) == full
    for d in DAYS:
        stored = os.listdir(f"{path}/features/label_day={d.label_day}".removeprefix("file:"))
        assert 1 <= sum(n.endswith(".parquet") for n in stored) <= PIECES


def test_a_store_is_emptied_of_days_where_nothing_is_left(spark, log):
    path = fresh_path(spark, "store")
    put_log_days(path, log, window_days(DAYS), CFG)
    put_label_days(spark, path, DAYS[:3], CFG)
    day = DAYS[1].sample_day
    kept = rows_of(features_table(spark, path, CFG).filter(F.col("label_day") != F.lit(DAYS[1].label_day)))
    put_log_days(path, log.filter(F.lit(False)), [day], CFG)
    put_label_days(spark, path, DAYS[1:2], CFG)
    assert not exists(spark, f"{path}/rollup/day={day}") and not exists(spark, f"{path}/sketches/day={day}")
    assert not exists(spark, f"{path}/features/label_day={DAYS[1].label_day}")
    assert rows_of(features_table(spark, path, CFG)) == kept


def test_update_job_makes_a_store_and_adds_a_day(spark, log, tmp_path, full):
    prepared, store = str(tmp_path / "prepared"), str(tmp_path / "store")
    io.write_prepared(log, prepared)
    before = replace(CFG, last_label_day=DAYS[1].label_day)
    assert len(jobs.update_job(spark, prepared, store, [], before)) == CFG.n_label_days
    new = [d for d in window_days(DAYS) if d not in window_days(label_days(before, TRAIN))]
    assert jobs.update_job(spark, prepared, store, new, CFG) == [DAYS[0].label_day]
    assert rows_of(features_table(spark, store, CFG)) == full


def test_sketches_of_a_store_serve_its_features(spark, log):
    cfg = replace(CFG, approximate_users=True)
    path = fresh_path(spark, "store")
    update(path, log, window_days(DAYS), cfg)
    exact = train_features(materialize(base_rollup(log), "rollup", "day"), CFG)
    # So few users are counted without error.
    assert rows_of(features_table(spark, path, cfg)) == rows_of(exact)


@pytest.fixture(scope="module")
def calendar(spark):
    both = calendar_rows(spark, "train", DAYS, CFG).unionByName(
        calendar_rows(spark, "score", label_days(CFG, SCORE), CFG)
    )
    return materialize(both, "calendar")


def test_a_stored_calendar_prunes_while_the_query_runs(spark, log, rollup, calendar):
    for run in ("train", "score"):
        days = label_days(CFG, run)
        own = calendar.filter(F.col("run") == run)
        found = calendar_data.long_window(log, own)
        assert "dynamicpruning" in plan_of(found).lower()
        assert rows_of(found) == rows_of(long_window(log, days, CFG).select(*found.columns))
    own = calendar.filter(F.col("run") == "train")
    assert rows_of(calendar_data.samples(log, own, CFG)) == rows_of(samples(log, DAYS, CFG, True))
    counted = calendar_data.window_counts(rollup, USER_CATEGORY, "d5", own)
    assert "dynamicpruning" in plan_of(counted).lower()
    from dayrank.operators.blocks import window_counts

    for window in ("long", "d1", "d3", "d5", "d7"):
        found = calendar_data.window_counts(rollup, USER_ITEM, window, own)
        assert rows_of(found) == rows_of(window_counts(rollup, USER_ITEM, window, DAYS, CFG))


def test_files_of_pruned_days_are_not_opened(spark, log, calendar):
    one = calendar.filter(F.col("run") == "score")
    found = calendar_data.long_window(log, one)
    found.collect()
    executed = found._jdf.queryExecution().executedPlan()
    (scan,) = [x for x in re.findall(r"FileScan parquet \[[^\n]*", executed.toString()) if "behavior_type" in x][:1]
    assert "dynamicpruning" in scan
    (day,) = label_days(CFG, SCORE)
    assert {r.day for r in found.select("day").distinct().collect()} <= {
        day.long_from + timedelta(days=k) for k in range(day.long_back + 1)
    }


def test_no_rows_and_no_calendar(spark, log, calendar):
    assert calendar_data.long_window(log, calendar.filter("run = 'none'")).count() == 0
    assert calendar_data.long_window(log.filter("false"), calendar.filter("run = 'train'")).count() == 0


def test_a_layout_by_user_leaves_samples_where_they_are(rollup, full):
    layout = by_user(rollup, CFG, 5)
    assert not layout.has_hot
    spark = rollup.sparkSession
    before = spark.conf.get(CO_PARTITION)
    with joined_as_they_lie(spark):
        plan = plan_of(placed_samples(layout.bucketed, DAYS, CFG, True, True)[0])
    assert spark.conf.get(CO_PARTITION) == before
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    found = placed_train_features(layout, CFG)
    assert not re.search(r"Exchange hashpartitioning\((label_day#\d+, )?user_id", plan_of(found))
    assert not re.search(r"Exchange hashpartitioning\(user_id", plan)
    assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan
    assert rows_of(found) == full


def test_hot_users_are_kept_apart(rollup, full):
    cfg = replace(CFG, hot_rows=100, hot_share=8)
    layout = by_user(rollup, cfg, 5)
    assert layout.has_hot
    hot = {r.user_id for r in layout.rest.select("user_id").distinct().collect()}
    assert {1, None} <= hot and len(hot) < 10
    assert not hot & {r.user_id for r in layout.bucketed.select("user_id").distinct().collect()}
    assert rows_of(placed_train_features(layout, cfg)) == full
    small = replace(cfg, broadcast_values=0)
    assert rows_of(placed_train_features(layout, small)) == full


def test_score_features_and_extras_of_a_layout(rollup):
    cfg = replace(CFG, extras=True, sample_behaviours=(3, 2))
    layout = by_user(rollup, cfg)
    assert rows_of(placed_score_features(layout, cfg)) == rows_of(score_features(rollup, cfg))


def test_tables_of_a_layout_go_with_the_job(spark, rollup):
    with temporary_tables(spark):
        layout = by_user(rollup, CFG, 3)
        names = [t.name for t in spark.catalog.listTables() if t.name.startswith("by_user")]
        assert names and layout.whole.count() == rollup.count()
    left = [t.name for t in spark.catalog.listTables() if t.name.startswith("by_user")]
    assert len(left) < len(names)

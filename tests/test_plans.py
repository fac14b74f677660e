"""What the physical plans must and must not contain."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date

import pytest

from dayrank.operators.label_calendar import SCORE, TRAIN, label_days
from dayrank.operators.rollup import base_rollup
from dayrank.plans.catalog import catalog
from dayrank.plans.features import score_features, train_features
from dayrank.session import materialize
from dayrank.sources.warehouse import EVENTS_CONFIG as CFG
from dayrank.sources.warehouse import prepared_log
from tests.conftest import SF

#: These run a job while they are built and return a frame over its output.
STORED = {"submission", "io_roundtrip", "gbt_rank", "gbt_checks", "gbt_stored", "quarantine"}
QUERIES = catalog()
#: One window and one ratio stand for their family.
ALIKE = {n for n in QUERIES if n.startswith("cnt_") and not n.endswith(("_long", "_d1"))}
ALIKE |= {n for n in QUERIES if n.startswith(("ratio_d3", "ratio_d5", "avg_"))}


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STORED - ALIKE))
def test_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for banned in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct",
                   "BroadcastNestedLoopJoin", "Scan ExistingRDD"):
        assert banned not in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["cnt_category_d1"](spark, SF)._jdf.queryExecution().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    events = [s for s in schemas if "event_type" in s]
    assert events and all("value" not in s and "event_id" not in s for s in events)
    assert "In(event_type, [click,purchase,signup,view])" in plan


@pytest.fixture(scope="module")
def rollup(spark):
    return materialize(base_rollup(prepared_log(spark, SF)), "rollup", "day")


def test_feature_table_shuffles(rollup):
    """At most two moves of the sample rows, small blocks sent to them, no key-skew machinery
    where no key is hot, and windows pushed to the scans as literal days."""
    first = min(d.long_from for d in label_days(CFG, TRAIN))
    for cfg, most in ((CFG, 15), (replace(CFG, broadcast_values=0), 20)):
        plan = plan_of(train_features(rollup, cfg))
        assert "salt" not in plan
        exchanges = len(re.findall(r"Exchange hashpartitioning", plan))
        assert exchanges <= most, exchanges
        scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
        assert scans and all(f"day#" in s and f">= {first}" in s for s in scans)


def test_pairs_are_shuffled_once(rollup):
    found = train_features(rollup, CFG)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_pair = r"Exchange hashpartitioning\(user_id#\w+, item_id#\w+, \d+\), REPARTITION_BY_COL"
    reused = [line for line in plan.splitlines() if "ReusedExchange [user_id" in line]
    assert len(reused) == 1 and re.search(by_pair, reused[0])
    assert len(re.findall(by_pair, plan)) == 2


def test_score_reads_its_window_only(rollup):
    (day,) = label_days(CFG, SCORE)
    plan = plan_of(score_features(rollup, CFG))
    assert day.long_from == date(2024, 1, 22)
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert scans and all(f">= {day.long_from}" in s or f"= {day.sample_day}" in s for s in scans)


def test_score_windows_see_keys_of_the_sample_day_only(rollup):
    """Below the windows of users, pairs and users with categories the other keys are gone."""
    lines = plan_of(score_features(rollup, CFG)).splitlines()
    depth = [len(re.match(r"[\s:+\-*()0-9]*", line)[0]) for line in lines]
    checked = 0
    for at, line in enumerate(lines):
        if "Window [" in line and "windowspecdefinition(user_id" in line and "next1" not in line:
            end = next((k for k in range(at + 1, len(lines)) if depth[k] <= depth[at]), len(lines))
            assert any("LeftSemi" in below for below in lines[at:end]), line
            checked += 1
    assert checked >= 3

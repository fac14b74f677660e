from __future__ import annotations

import os
from dataclasses import replace

import pytest

from checks.skewed_log import skewed_log, task_rows
from dayrank.operators.rollup import base_rollup
from dayrank.plans import jobs
from dayrank.plans.catalog import catalog
from dayrank.plans.features import train_features
from dayrank.session import materialize, require_shared, shared_folder
from dayrank.sources import behaviour as io
from dayrank.sources.warehouse import EVENTS_CONFIG
from tests.conftest import SF


def test_result_does_not_depend_on_the_sessions_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    query = catalog()["prep_log"]
    columns = ("user_id", "item_id", "time", "hour", "day")
    wanted = sorted(map(tuple, query(spark, SF).select(*columns).collect()))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        found = sorted(map(tuple, query(spark, SF).select(*columns).collect()))
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == wanted


def test_a_local_folder_is_no_shared_one_on_a_cluster():
    for folder in ("file:/home/x/warehouse", "/home/x/warehouse", "warehouse"):
        require_shared(folder, "local[8]")
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            require_shared(folder, "spark://host:7077")
    require_shared("hdfs://name/warehouse", "yarn")


@pytest.fixture(scope="module")
def skewed(spark):
    return materialize(base_rollup(skewed_log(spark, 60_000)), "rollup", "day")


def test_jobs_leave_no_intermediate_tables(spark, tmp_path):
    log = skewed_log(spark, 3000)
    paths = {name: str(tmp_path / name) for name in ("prepared", "train", "score", "out")}
    io.write_prepared(log, paths["prepared"])
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    cfg = replace(EVENTS_CONFIG, boosting_rounds=1)
    jobs.features_job(spark, paths["prepared"], paths["train"], paths["score"], cfg)
    jobs.rank_job(spark, paths["train"], paths["score"], paths["out"], cfg, with_prob=True)
    left = {n for n in set(os.listdir(folder)) - before if "-" in n and n.split("-")[0] in ("rollup", "training", "labels")}
    assert not left
    ranked = io.read_submission(spark, paths["out"], with_prob=True)
    assert ranked.columns == ["user_id", "item_id", "prob"] and ranked.count() > 0


def test_tasks_stay_even_with_hot_keys(spark, skewed):
    """A user and an item with a third of the rows each: rows of the last shuffle's tasks."""
    cfg = replace(EVENTS_CONFIG, hot_rows=50, broadcast_values=0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sizes = {
            name: task_rows(train_features(skewed, c).select("user_id", "item_id", "uc_long_b1", "i_long_b1"))
            for name, c in (("spread", cfg), ("plain", replace(cfg, hot_rows=10**9)))
        }
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes["spread"]) == sum(sizes["plain"])
    mean = sum(sizes["spread"]) / len(sizes["spread"])
    assert sizes["spread"][-1] <= 2 * mean
    assert sizes["plain"][-1] > sizes["spread"][-1]

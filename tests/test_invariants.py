"""Relations between features that hold on any log, checked on the generated events."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dayrank.operators.label_calendar import TRAIN, label_days
from dayrank.operators.rollup import base_rollup
from dayrank.operators.samples import samples, samples_per_day
from dayrank.plans.features import train_features
from dayrank.schema import (
    BEHAVIOURS,
    ENTITIES,
    PURCHASE,
    USER,
    USER_CATEGORY,
    USER_ITEM,
    feature_columns,
    features_schema,
    profile_columns,
)
from dayrank.session import materialize
from dayrank.sources.warehouse import EVENTS_CONFIG as CFG
from dayrank.sources.warehouse import prepared_log, raw_log
from tests.conftest import SF

#: Samples and positives per label day, newest first.
PER_DAY = [
    (226, 1), (212, 3), (213, 2), (230, 0), (221, 0), (194, 3), (230, 1), (192, 0),
    (235, 0), (226, 0), (211, 1), (205, 0), (213, 1), (229, 0), (220, 0),
]


@pytest.fixture(scope="module")
def log(spark):
    return materialize(prepared_log(spark, SF), "test-log")


@pytest.fixture(scope="module")
def features(log):
    return materialize(train_features(base_rollup(log), CFG), "test-features")


def test_row_counts(spark, log):
    assert raw_log(spark, SF).count() == 7986
    assert log.count() == 6080
    counted = (
        samples(log, label_days(CFG, TRAIN), CFG, True)
        .groupBy("label_day")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bought"))
        .orderBy(F.desc("label_day"))
    )
    assert [(r["n"], r["bought"]) for r in counted.collect()] == PER_DAY


def test_schema(features):
    assert [(f.name, f.dataType) for f in features.schema] == [
        (f.name, f.dataType) for f in features_schema(True)
    ]


def test_every_sample_once(log, features):
    found = {r["label_day"]: r["samples"] for r in samples_per_day(features).collect()}
    wanted = samples_per_day(samples(log, label_days(CFG, TRAIN), CFG, True)).collect()
    assert found == {r["label_day"]: r["samples"] for r in wanted}
    assert features.select("label_day", "user_id", "item_id").distinct().count() == features.count()


@pytest.mark.parametrize("entity", ENTITIES, ids=lambda e: e.name)
def test_windows_nest(features, entity):
    p = entity.prefix
    wrong = F.lit(False)
    for b in BEHAVIOURS:
        chain = [F.col(f"{p}_{w}_b{b}") for w in ("d1", "d3", "d5", "d7", "long")]
        for shorter, longer in zip(chain, chain[1:]):
            wrong = wrong | (shorter > longer)
    assert features.filter(wrong).count() == 0


@pytest.mark.parametrize("entity", [USER, USER_ITEM, USER_CATEGORY], ids=lambda e: e.name)
def test_profile_adds_up_to_the_one_day_count(features, entity):
    for b in BEHAVIOURS:
        cells = " + ".join(c for c in profile_columns(entity.profile) if c.endswith(f"_b{b}"))
        assert features.filter(f"{cells} <> {entity.prefix}_d1_b{b}").count() == 0


def test_bounds(features):
    for b in BEHAVIOURS:
        assert features.filter(f"i_uniq_b{b} > i_long_b{b}").count() == 0
        assert features.filter(f"ulive_days_b{b} > 9 OR ulive_days_b{b} > u_long_b{b}").count() == 0
    assert features.filter("ui_type_max NOT BETWEEN 1 AND 4").count() == 0
    assert features.filter("u_hour_range <> u_hour_max - u_hour_min").count() == 0


def test_no_nulls(features):
    assert features.na.drop(subset=feature_columns()).count() == features.count()


def test_positives_were_bought(log, features):
    bought = log.filter(F.col("behavior_type") == PURCHASE).select(
        F.col("day").alias("label_day"), "user_id", "item_id"
    )
    key = ["label_day", "user_id", "item_id"]
    positives = features.filter("label = 1")
    assert positives.count() == 12
    assert positives.join(bought, key, "left_anti").count() == 0
    assert features.filter("label = 0").join(bought, key, "left_semi").count() == 0

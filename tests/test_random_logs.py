"""Feature tables over logs the generated tables do not show: items in several categories,
one hot item, user and category, repeated rows, idle days, rows without a user, behaviours and hours
outside their domain or missing. The SQL is the queries' own, with
the log replaced."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import date, timedelta

import duckdb
import pytest

from checks import oracle
from dayrank.operators.blocks import entity_block, hour_profile
from dayrank.operators.label_calendar import SCORE, TRAIN, label_days
from dayrank.operators.rollup import base_rollup, daily_counts
from dayrank.operators.samples import samples
from dayrank.operators.sampling import downsample
from dayrank.operators.uniques import unique_users
from dayrank.plans.features import score_features, train_features, training_set
from dayrank.schema import ENTITIES, ITEM, USER_ITEM
from dayrank.sources.warehouse import EVENTS_CONFIG
from tests.compare import assert_same

CFG = EVENTS_CONFIG
#: Keys count as hot early here, and no block is small enough to be broadcast.
HOT_CFG = replace(CFG, hot_rows=5, broadcast_values=0)


def random_rows(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        day = date(2024, 1, 2) + timedelta(days=rng.randrange(29))
        if day in CFG.gap_days:
            continue
        user = 1 if rng.random() < 0.35 else rng.randrange(2, 12)
        item = 1 if rng.random() < 0.35 else rng.randrange(2, 9)
        category = 100 if rng.random() < 0.5 else 100 + rng.randrange(4)
        hour = rng.choice((0, 23, rng.randrange(24)))
        code = rng.randrange(1, 5)
        if rng.random() < 0.15:  # a row that is odd in one way
            odd = rng.choice(("user", "code", "hour"))
            user = None if odd == "user" else user
            code = rng.choice((0, 5, None)) if odd == "code" else code
            hour = rng.choice((24, -1, None)) if odd == "hour" else hour
        rows += [(user, item, category, code, day, hour)] * rng.choice((1, 1, 1, 3))
    # One item with rows without a user only, and one such row beside others.
    rows += [(None, 77, 100, 1, date(2024, 1, 28), 5)] * 3
    return rows


@pytest.fixture(scope="module")
def rows():
    return random_rows(1, 500)


@pytest.fixture(scope="module")
def duck(rows):
    connection = duckdb.connect()
    connection.execute(
        "CREATE TABLE given (user_id BIGINT, item_id BIGINT, item_category BIGINT, "
        "behavior_type INTEGER, day DATE, hour INTEGER)"
    )
    connection.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?, ?)", rows)
    return connection


@pytest.fixture(scope="module")
def sql():
    given = "\nlog AS (SELECT * FROM given)"
    return {name: text.replace(oracle.LOG, given) for name, text in oracle.oracle_sql().items()}


@pytest.fixture
def log(make_log, rows):
    return make_log(rows)


@pytest.mark.parametrize("cfg", [CFG, HOT_CFG], ids=["plain", "hot"])
def test_train_features(log, duck, sql, cfg):
    found = train_features(base_rollup(log), cfg)
    assert assert_same(found, duck.sql(sql["train_features"])) > 100


@pytest.mark.parametrize("cfg", [CFG, HOT_CFG], ids=["plain", "hot"])
def test_score_features(log, duck, sql, cfg):
    assert assert_same(score_features(base_rollup(log), cfg), duck.sql(sql["score_features"])) > 0


def test_train_features_with_extras(log, duck, sql):
    found = train_features(base_rollup(log), replace(HOT_CFG, extras=True))
    assert assert_same(found, duck.sql(sql["train_features_extras"])) > 100


@pytest.mark.parametrize("entity", ENTITIES, ids=lambda e: e.name)
def test_whole_blocks(log, duck, sql, entity):
    found = entity_block(base_rollup(log), entity, label_days(CFG, TRAIN), CFG)
    assert_same(found, duck.sql(sql[f"feat_{entity.name}"]))


@pytest.mark.parametrize("name", ["user", "user_item", "user_category"])
def test_hour_profiles(log, duck, sql, name):
    entity = next(e for e in ENTITIES if e.name == name)
    found = hour_profile(base_rollup(log), entity, label_days(CFG, TRAIN), CFG)
    assert_same(found, duck.sql(sql[f"hour_profile_{name}"]))


def test_unique_users(log, duck, sql):
    pairs = daily_counts(base_rollup(log), USER_ITEM.keys)
    found = unique_users(pairs, ITEM, label_days(CFG, TRAIN), CFG)
    assert_same(found, duck.sql(sql["uniq_users_item"]))


def test_samples(log, duck, sql):
    days = label_days(CFG, TRAIN)
    assert_same(samples(log, days, CFG, True), duck.sql(sql["train_labels"]))
    score = samples(log, label_days(CFG, SCORE), CFG, False)
    assert_same(score, duck.sql(sql["score_samples"]))
    subset = replace(CFG, sample_behaviours=(3, 2))
    assert_same(samples(log, days, subset, True), duck.sql(sql["samples_subset"]))


def test_features_of_a_behaviour_subset_have_its_samples(log):
    subset = replace(CFG, sample_behaviours=(3, 2))
    ids = ["label_day", "user_id", "item_id", "item_category", "label"]
    found = train_features(base_rollup(log), subset).select(ids)
    wanted = samples(log, label_days(CFG, TRAIN), subset, True).select(ids)
    assert sorted(found.collect()) == sorted(wanted.collect())


def test_training_set_is_the_downsampled_feature_table(log):
    cfg = replace(CFG, negatives_per_positive=1)
    rollup = base_rollup(log)
    found = training_set(rollup, cfg)
    wanted = downsample(train_features(rollup, cfg), cfg)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))

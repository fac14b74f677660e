"""Mergeable user sketches, the Bernoulli sample and its weights, and the stored model."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from dayrank.operators.distinct_sketches import compare, estimated_users, relative_error, user_sketches
from dayrank.operators.label_calendar import TRAIN, label_days
from dayrank.operators.model import load_model, predict, save_model, train
from dayrank.operators.rollup import base_rollup, daily_counts
from dayrank.operators.sampling import bernoulli, class_fractions, downsample, drawn
from dayrank.operators.uniques import unique_users
from dayrank.plans import jobs
from dayrank.schema import ITEM, USER_ITEM, feature_columns
from dayrank.session import fresh_path, materialize
from dayrank.sources import behaviour as io
from dayrank.sources.warehouse import EVENTS_CONFIG as CFG

DAYS = label_days(CFG, TRAIN)
SAMPLES = "label_day date, user_id long, item_id long, label int"


@pytest.fixture(scope="module")
def crowded(spark):
    """A log in which one item has many users, several days each."""
    n = 60_000
    day = F.date_add(F.lit(date(2024, 1, 10)), (F.col("id") % 20).cast("int"))
    return materialize(
        spark.range(n).select(
            (F.xxhash64("id") % 20_000).alias("user_id"),
            F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 50).cast("long").alias("item_id"),
            (F.col("id") % 4 + 1).cast("int").alias("behavior_type"),
            F.lit(1).cast("long").alias("item_category"),
            F.lit(0).alias("hour"),
            day.alias("day"),
        ).filter(~F.col("day").isin(*CFG.gap_days)),
        "crowded",
        "day",
    )


def test_estimates_are_within_their_error(crowded):
    exact = unique_users(daily_counts(base_rollup(crowded), USER_ITEM.keys), ITEM, DAYS, CFG)
    top = exact.agg(F.max("i_uniq_b1")).first()[0]
    assert top > 3000  # beyond what a sketch counts without error
    for lg_k in (8, 12):
        cfg = replace(CFG, sketch_lg_k=lg_k)
        estimated = estimated_users(user_sketches(crowded, cfg), DAYS, cfg)
        found = compare(exact, estimated, cfg).collect()
        assert len(found) == 4 * len(DAYS) and all(r.n_beyond == 0 for r in found)
    rough = estimated_users(user_sketches(crowded, replace(CFG, sketch_lg_k=6)), DAYS, CFG)
    assert sum(r.n_beyond for r in compare(exact, rough, CFG).collect()) > 0
    assert relative_error(12) == pytest.approx(0.01625)


def test_a_window_is_the_union_of_its_days(spark, crowded):
    """Sketches of days, counted apart and stored, give what sketches of the whole log give."""
    path = fresh_path(spark, "sketches")
    days = [r.day for r in crowded.select("day").distinct().collect()]
    for day in days:
        user_sketches(crowded.filter(F.col("day") == F.lit(day)), CFG).write.mode("append").parquet(path)
    apart = estimated_users(spark.read.parquet(path), DAYS, CFG)
    whole = estimated_users(user_sketches(crowded, CFG), DAYS, CFG)
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, whole.collect()))


def test_sketches_of_odd_rows(make_log):
    day = DAYS[0].sample_day
    log = make_log([
        (None, 5, 1, 1, day, 3), (1, 5, 1, 1, day, 4), (1, 5, 1, 1, day - timedelta(days=1), 4),
        (None, 6, 1, 2, day, 3), (2, None, 1, 1, day, 3), (3, 5, 1, 9, day, 3),
    ])
    found = {
        (r.label_day, r.item_id): tuple(r[f"i_uniq_b{b}"] for b in (1, 2, 3, 4))
        for r in estimated_users(user_sketches(log, CFG), DAYS[:1], CFG).collect()
    }
    assert found == {(DAYS[0].label_day, 5): (1, 0, 0, 0), (DAYS[0].label_day, 6): (0, 0, 0, 0)}
    assert estimated_users(user_sketches(log.filter("false"), CFG), DAYS, CFG).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(31)
    day = date(2024, 1, 20)
    rows = [(day, u, i, int(rng.random() < 0.01)) for u in range(200) for i in range(50)]
    return spark.createDataFrame(rows, SAMPLES)


def test_bernoulli_sample_is_repeatable_and_of_the_expected_size(labelled):
    cfg = replace(CFG, negatives_per_positive=10)
    first = bernoulli(labelled, cfg)
    again = bernoulli(labelled.repartition(7, "item_id").orderBy(F.desc("user_id")), cfg)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    other = bernoulli(labelled, replace(cfg, seed=11))
    assert set(map(tuple, first.collect())) != set(map(tuple, other.collect()))
    positives = labelled.filter("label = 1").count()
    negatives = labelled.count() - positives
    share = class_fractions(labelled, cfg)[0]
    assert share == 10 * positives / negatives
    drawn_negatives = first.filter("label = 0").count()
    assert first.filter("label = 1").count() == positives
    assert abs(drawn_negatives - 10 * positives) < 4 * (negatives * share * (1 - share)) ** 0.5


def test_weights_add_up_to_the_population(labelled):
    found = bernoulli(labelled, replace(CFG, negatives_per_positive=10))
    sums = {r.label: r.total for r in found.groupBy("label").agg(F.sum("weight").alias("total")).collect()}
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    assert sums == pytest.approx(counts)


def test_given_fractions_need_no_count(labelled):
    rows = labelled.filter(drawn({1: 1.0, 0: 0.25}, CFG))
    n = rows.filter("label = 0").count()
    all_negatives = labelled.filter("label = 0").count()
    assert abs(n - all_negatives / 4) < 4 * (all_negatives * 0.25 * 0.75) ** 0.5
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert bernoulli(labelled.filter("false"), CFG).collect() == []
    only = bernoulli(labelled.filter("label = 1"), CFG)
    assert {r.weight for r in only.collect()} == {1.0}
    assert bernoulli(labelled.filter("label = 0"), CFG).count() == 0


def features(spark, n: int, with_label: bool):
    """Feature rows in which one column tells the label."""
    cfg = replace(CFG, boosting_rounds=3)
    schema = io.features_schema(with_label, cfg.sub_windows, cfg.extras)
    telling = F.col("id") % 10 == 0
    columns = []
    for field in schema.fields:
        kind = field.dataType
        value = {
            "label_day": F.lit(date(2024, 1, 20)), "user_id": F.col("id"), "item_id": F.col("id") % 7,
            "item_category": F.lit(1), "label": telling.cast("int"),
            "ui_d1_b3": F.when(telling, 5).otherwise(F.col("id") % 2),
        }.get(field.name, F.xxhash64("id", F.lit(field.name)) % 3)
        columns.append(value.cast(kind).alias(field.name))
    return spark.range(n).select(*columns), cfg


def test_trees_use_the_weights(spark):
    frame, cfg = features(spark, 600, True)
    same = frame.withColumn("weight", F.lit(1.0))
    heavy = frame.withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(40.0))
    score = frame.drop("label")
    means = [
        predict(train(materialize(x, "weighted"), cfg), score, cfg).agg(F.avg("prob")).first()[0]
        for x in (frame, same, heavy)
    ]
    assert means[0] == pytest.approx(means[1])
    assert means[2] < means[1]


def test_stored_model_scores_alike_and_checks_its_columns(spark, tmp_path):
    frame, cfg = features(spark, 400, True)
    frame = materialize(frame, "training")
    model = train(frame, cfg)
    path = str(tmp_path / "model")
    save_model(model, path, cfg)
    scoring = materialize(frame.drop("label"), "scoring")
    wanted = sorted(map(tuple, predict(model, scoring, cfg).collect()))
    assert sorted(map(tuple, predict(load_model(spark, path, cfg), scoring, cfg).collect())) == wanted
    for other in (replace(cfg, sub_windows=(5, 7, 3)), replace(cfg, extras=True), replace(cfg, slot=9)):
        with pytest.raises(ValueError, match="trained on other features"):
            load_model(spark, path, other)
    shifted = feature_columns(cfg.sub_windows)
    text = spark.read.text(f"{path}/columns").first()["value"].replace(shifted[0], "u_other", 1)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/columns")
    with pytest.raises(ValueError, match="column 0 is 'u_other'"):
        load_model(spark, path, cfg)


def test_the_loss_falls_with_the_rounds_and_positives_rank_first(spark):
    """Trees learn: a model of a label that a column tells is better than chance, and gets better."""
    frame, cfg = features(spark, 600, True)
    frame = materialize(frame, "training")
    scoring = frame.drop("label")
    loss = []
    for rounds in (1, 8):
        scored = predict(train(frame, replace(cfg, boosting_rounds=rounds)), scoring, cfg).join(
            frame.select("label_day", "user_id", "item_id", "label"), ["label_day", "user_id", "item_id"]
        )
        p = F.when(F.col("label") == 1, F.col("prob")).otherwise(1 - F.col("prob"))
        loss.append(scored.agg(F.avg(-F.log(p))).first()[0])
        means = {r.label: r.m for r in scored.groupBy("label").agg(F.avg("prob").alias("m")).collect()}
        assert means[1] > means[0]
    assert loss[1] < loss[0] < 0.6931


def test_train_and_score_as_jobs_of_their_own(spark, tmp_path):
    frame, cfg = features(spark, 300, True)
    cfg = replace(cfg, top_k=20, negatives_per_positive=3)
    paths = {n: str(tmp_path / n) for n in ("train", "score", "model", "out", "ranked", "weighted")}
    io.write_features(frame, paths["train"])
    io.write_features(frame.drop("label"), paths["score"])
    jobs.train_job(spark, paths["train"], paths["model"], cfg)
    jobs.score_job(spark, paths["model"], paths["score"], paths["out"], cfg)
    jobs.rank_job(spark, paths["train"], paths["score"], paths["ranked"], cfg)
    found = io.read_submission(spark, paths["out"]).collect()
    assert len(found) == 20 and found == io.read_submission(spark, paths["ranked"]).collect()
    jobs.rank_job(spark, paths["train"], paths["score"], paths["weighted"], replace(cfg, sampling="bernoulli"))
    assert io.read_submission(spark, paths["weighted"]).count() == 20
    assert downsample(io.read_features(spark, paths["train"], True), cfg).count() == 120

"""How the rows of a training set are dealt to the tasks that train."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dayrank.operators import model
from dayrank.schema import SAMPLE_KEY, feature_columns
from dayrank.session import materialize
from dayrank.sources.warehouse import EVENTS_CONFIG

CFG = replace(EVENTS_CONFIG, boosting_rounds=2)
FEATURES = feature_columns(CFG.sub_windows)
ROWS, A_TASK = 1200, 50


@pytest.fixture(scope="module")
def one_file(spark):
    """A training set in one file: mostly zeros, some features with the label or at random."""
    filled = {c: (F.col("id") * (at + 3) % 7 + F.col("id") % 2).cast("long") for at, c in enumerate(FEATURES[::40])}
    frame = spark.range(0, ROWS, 1, 1).select(
        F.lit(CFG.last_label_day).alias("label_day"),
        (F.col("id") % 90).alias("user_id"),
        F.col("id").alias("item_id"),
        (F.col("id") % 2).cast("int").alias("label"),
        *(filled.get(c, F.lit(0)).alias(c) for c in FEATURES),
    )
    return materialize(frame, "one-file")


class Seen:
    """Takes the place of the trainer and notes the rows each task would train on."""

    def fit(self, rows):
        self.columns = rows.columns
        self.keys = sorted(map(tuple, rows.select(*SAMPLE_KEY).collect()))
        self.sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]


def dealt(frame, cfg=CFG) -> Seen:
    seen = Seen()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(model, "classifier", lambda *_: seen)
        model.train(frame, cfg)
    return seen


def test_a_task_trains_on_a_bounded_number_of_rows(one_file, monkeypatch):
    monkeypatch.setattr(model, "TASK_VALUES", A_TASK * len(FEATURES), raising=False)
    seen = dealt(one_file)
    assert sum(seen.sizes) == ROWS and len(seen.sizes) == ROWS // A_TASK
    assert max(seen.sizes) < 2 * A_TASK
    assert seen.keys == sorted(map(tuple, one_file.select(*SAMPLE_KEY).collect()))


def test_twice_the_rows_are_twice_the_tasks(one_file, monkeypatch):
    monkeypatch.setattr(model, "TASK_VALUES", A_TASK * len(FEATURES), raising=False)
    twice = one_file.unionByName(one_file.withColumn("item_id", F.col("item_id") + ROWS))
    seen = dealt(twice)
    assert sum(seen.sizes) == 2 * ROWS and max(seen.sizes) < 2 * A_TASK


def test_what_a_task_can_hold_stays_as_it_lies(one_file):
    assert dealt(one_file).sizes == [ROWS]


def test_the_model_does_not_depend_on_the_files(one_file, monkeypatch):
    monkeypatch.setattr(model, "TASK_VALUES", 200 * len(FEATURES), raising=False)
    other = materialize(one_file.repartition(5, "item_id"), "five-files")
    found = [model.train(frame, CFG).toDebugString.split("\n", 1)[1] for frame in (one_file, other)]
    assert found[0] == found[1] and "Predict" in found[0]

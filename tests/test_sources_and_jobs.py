from __future__ import annotations

from dataclasses import replace

import pytest

from dayrank.__main__ import main
from dayrank.config import FeatureConfig
from dayrank.operators.model import classifier, predict, train, vectors
from dayrank.operators.ranking import top_k
from dayrank.operators.rollup import base_rollup
from dayrank.plans import jobs
from dayrank.plans.features import score_features, training_set
from dayrank.schema import feature_columns
from dayrank.session import materialize, shared_folder
from dayrank.sources import behaviour as io
from dayrank.sources.warehouse import EVENTS_CONFIG, item_list, prepared_log, raw_log
from tests.conftest import SF

CFG = replace(EVENTS_CONFIG, boosting_rounds=2)


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    """A raw log and item list as CSV files, and the outputs of all three jobs."""
    root = tmp_path_factory.mktemp("jobs")
    found = {n: str(root / n) for n in ("log", "items", "prepared", "train", "score", "result")}
    raw_log(spark, SF).write.csv(found["log"], header=True)
    item_list(spark, SF).write.csv(found["items"], header=True)
    jobs.prepare_job(spark, found["log"], found["items"], found["prepared"], CFG)
    jobs.features_job(spark, found["prepared"], found["train"], found["score"], CFG)
    jobs.rank_job(spark, found["train"], found["score"], found["result"], CFG)
    return found


def test_prepared_log(spark, paths):
    found = io.read_prepared(spark, paths["prepared"])
    columns = sorted(found.columns)
    wanted = prepared_log(spark, SF).select(columns)
    assert sorted(found.select(columns).collect()) == sorted(wanted.collect())


def test_prepared_log_is_read_by_day(spark, paths):
    plan = io.read_prepared(spark, paths["prepared"], cfg=CFG)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_features_on_storage(spark, paths):
    assert io.read_features(spark, paths["train"], True).count() == 3257
    assert io.read_features(spark, paths["score"], False).count() == 211


def test_submission(spark, paths):
    found = io.read_submission(spark, paths["result"])
    assert found.columns == ["user_id", "item_id"]
    # Fewer candidates than K: all of them are submitted.
    assert found.count() == found.distinct().count() == 211
    (text,) = {line for line in spark.read.text(paths["result"]).toPandas()["value"] if "user" in line}
    assert text == "user_id,item_id"


def test_features_as_csv(spark, paths, tmp_path):
    scored = io.read_features(spark, paths["score"], False)
    io.write_features(scored, str(tmp_path / "csv"), io.CSV)
    again = io.read_features(spark, str(tmp_path / "csv"), False, io.CSV)
    assert sorted(again.collect()) == sorted(scored.collect())


DAYS = ["--last-label-day", "2024-01-30", "--gap-day", "2024-01-23", "--gap-day", "2024-01-24"]


def test_command_line_prepare(spark, paths, tmp_path):
    out = str(tmp_path / "prepared")
    main([*DAYS, "--format", "csv", "prepare", paths["log"], paths["items"], out])
    assert io.read_prepared(spark, out, io.CSV).count() == 6080


def test_command_line_evaluate(spark, paths, tmp_path):
    """The submission of the last day, taken as a forecast for the day after an earlier one."""
    out = str(tmp_path / "metrics")
    main(["--last-label-day", "2024-01-21", "evaluate", paths["prepared"], paths["result"], out])
    (row,) = spark.read.json(out).collect()
    assert row["predicted"] == 211 and row["actual"] > 0
    assert row["precision"] == row["tp"] / 211


def test_shared_folder_is_the_clusters(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_model(spark):
    rollup = materialize(base_rollup(prepared_log(spark, SF)), "rollup")
    chosen = materialize(training_set(rollup, CFG), "chosen")
    assert chosen.count() == 1092
    scoring = materialize(score_features(rollup, CFG), "scoring")
    assert vectors(chosen, CFG).first()["features"].size == len(feature_columns()) == 426
    scored = predict(train(chosen, CFG), scoring, CFG)
    rows = scored.collect()
    assert len(rows) == scoring.count()
    assert all(0.0 <= r["prob"] <= 1.0 for r in rows)
    again = predict(train(chosen, CFG), scoring, CFG)
    assert top_k(scored, 50).collect() == top_k(again, 50).collect()


def test_model_settings():
    found = classifier(EVENTS_CONFIG)
    assert (found.getMaxDepth(), found.getStepSize(), found.getSubsamplingRate()) == (4, 0.02, 0.8)
    assert (found.getFeatureSubsetStrategy(), found.getSeed()) == ("0.8", 10)
    assert classifier(replace(CFG, boosting_rounds=900)).getMaxIter() == 900


def test_queries_and_jobs_train_all_rounds_of_the_original(spark):
    assert classifier(EVENTS_CONFIG).getMaxIter() == 900
    assert classifier(FeatureConfig()).getMaxIter() == 900

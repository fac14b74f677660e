"""Batch jobs from files to files: prepare, features, rank, evaluate."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.operators import evaluate as metrics
from dayrank.operators.model import load_model, predict, save_model, train
from dayrank.operators.prepare import prepare_log
from dayrank.operators.ranking import top_k
from dayrank.operators.quarantine import accepted, quarantined
from dayrank.operators.rollup import base_rollup
from dayrank.operators.sampling import bernoulli, downsample
from dayrank.operators.label_calendar import TRAIN, label_days
from dayrank.plans.features import score_features, train_features
from dayrank.plans.store import stored_label_days, update, window_days
from dayrank.session import materialize, temporary_tables, tune
from dayrank.sources import behaviour as io


def prepare_job(
    spark: SparkSession,
    log_path: str,
    items_path: str,
    out: str,
    cfg: FeatureConfig,
    fmt: str = io.PARQUET,
) -> None:
    """Raw CSV log and item list to the prepared log. Rows that cannot be read are written to
    ``<out>-quarantine``, as lines with their source and reason, and counted in ``<out>-quarantine-counts``."""
    tune(spark)
    log, items = io.read_raw_log_checked(spark, log_path), io.read_items_checked(spark, items_path)
    io.write_prepared(prepare_log(accepted(log), accepted(items), cfg), out, fmt)
    lines = quarantined(log).withColumn("source", F.lit("log"))
    lines = lines.unionByName(quarantined(items).withColumn("source", F.lit("items")))
    io.write_quarantine(lines, f"{out}-quarantine")
    found = spark.read.schema("line string, source string, reason string").parquet(f"{out}-quarantine")
    counted = found.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n_rows"))
    counted.coalesce(1).write.mode("overwrite").json(f"{out}-quarantine-counts")


def features_job(
    spark: SparkSession,
    prepared: str,
    train_out: str,
    score_out: str,
    cfg: FeatureConfig,
    fmt: str = io.PARQUET,
) -> None:
    """Prepared log to the training and score feature tables."""
    tune(spark)
    log = io.read_prepared(spark, prepared, fmt, cfg)
    with temporary_tables(spark):
        rollup = materialize(base_rollup(log), "rollup", "day")
        io.write_features(train_features(rollup, cfg), train_out, fmt)
        io.write_features(score_features(rollup, cfg), score_out, fmt)


def rank_frame(chosen: DataFrame, scoring: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Train on the chosen (downsampled) rows, score, keep the best pairs with their
    probability. The chosen rows are written first: training reads them in every round."""
    model = train(materialize(chosen, "training-set"), cfg)
    return top_k(predict(model, scoring, cfg), cfg.top_k)


def rank_job(
    spark: SparkSession,
    train_path: str,
    score_path: str,
    out: str,
    cfg: FeatureConfig,
    fmt: str = io.PARQUET,
    with_prob: bool = False,
) -> None:
    """Feature tables to the submission file, ``with_prob`` with each pair's probability."""
    tune(spark)
    training = io.read_features(spark, train_path, True, fmt, cfg)
    scoring = io.read_features(spark, score_path, False, fmt, cfg)
    with temporary_tables(spark):
        ranked = rank_frame(sampled(training, cfg), scoring, cfg)
        io.write_submission(ranked, out, with_prob)


def sampled(training: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """The rows to train on, with weights where they are a Bernoulli sample."""
    return bernoulli(training, cfg) if cfg.sampling == "bernoulli" else downsample(training, cfg)


def train_job(
    spark: SparkSession, train_path: str, model_path: str, cfg: FeatureConfig, fmt: str = io.PARQUET
) -> None:
    """Training features to a stored model."""
    tune(spark)
    training = io.read_features(spark, train_path, True, fmt, cfg)
    with temporary_tables(spark):
        chosen = materialize(sampled(training, cfg), "training-set")
        save_model(train(chosen, cfg), model_path, cfg)


def score_job(
    spark: SparkSession,
    model_path: str,
    score_path: str,
    out: str,
    cfg: FeatureConfig,
    fmt: str = io.PARQUET,
    with_prob: bool = False,
) -> None:
    """A stored model and score features to the submission file. The model's columns are checked."""
    tune(spark)
    model = load_model(spark, model_path, cfg)
    scored = predict(model, io.read_features(spark, score_path, False, fmt, cfg), cfg)
    io.write_submission(top_k(scored, cfg.top_k), out, with_prob)


def update_job(
    spark: SparkSession, prepared: str, store: str, log_days: Sequence[date], cfg: FeatureConfig
) -> list[date]:
    """Bring a store of rollup, sketches and training features up to the calendar after these log days
    arrived or changed in the prepared log. A store that does not exist is made, of all days."""
    tune(spark)
    log = io.read_prepared(spark, prepared)
    known = stored_label_days(spark, store)
    if not known:
        log_days = window_days(label_days(cfg, TRAIN))
    with temporary_tables(spark):
        return update(store, log, log_days, cfg, known)


def evaluate_frame(predicted: DataFrame, log: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Metrics of predicted pairs against all purchases of the day after the scored one."""
    return metrics.evaluate(predicted, metrics.actual_pairs(log, cfg.last_label_day))


def evaluate_job(
    spark: SparkSession,
    prepared: str,
    submission: str,
    out: str,
    cfg: FeatureConfig,
    fmt: str = io.PARQUET,
) -> None:
    """Submission file and prepared log to one JSON row of metrics."""
    tune(spark)
    predicted = io.read_submission(spark, submission)
    evaluate_frame(predicted, io.read_prepared(spark, prepared, fmt), cfg).write.json(out)

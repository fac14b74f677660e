"""Behaviour log, item list, prepared log, feature tables and submissions on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayrank.config import FeatureConfig
from dayrank.operators.label_calendar import SCORE, TRAIN, day_range, label_days
from dayrank.operators.quarantine import MALFORMED
from dayrank.schema import ITEMS, PREPARED_LOG, RAW_LOG, SUBMISSION, features_schema

PARQUET = "parquet"
CSV = "csv"


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True, enforceSchema=False) if fmt == CSV else reader.parquet(path)


def read_raw_log(spark: SparkSession, path: str, fmt: str = CSV) -> DataFrame:
    return _read(spark, path, RAW_LOG, fmt)


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV rows with a further column that holds the whole line where it does not fit the schema.

    The reader only converts columns that a plan needs, and sees bad values in no others. So the further
    column is made to need all of them, and a row is judged the same in every plan.
    """
    with_line = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    rows = (
        spark.read.schema(with_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .csv(path, header=True, enforceSchema=False)
    )
    needs_all = F.length(F.concat_ws("", *(F.col(c).cast("string") for c in schema.fieldNames()))) >= 0
    return rows.withColumn(MALFORMED, F.when(needs_all, F.col(MALFORMED)))


def read_raw_log_checked(spark: SparkSession, path: str) -> DataFrame:
    return read_checked(spark, path, RAW_LOG)


def read_items_checked(spark: SparkSession, path: str) -> DataFrame:
    return read_checked(spark, path, ITEMS)


def write_quarantine(quarantine: DataFrame, path: str) -> None:
    """The quarantined lines as Parquet, a folder per source and reason."""
    quarantine.write.mode("overwrite").partitionBy("source", "reason").parquet(path)


def read_items(spark: SparkSession, path: str, fmt: str = CSV) -> DataFrame:
    return _read(spark, path, ITEMS, fmt)


def write_prepared(log: DataFrame, path: str, fmt: str = PARQUET) -> None:
    """Parquet with one folder per day, so that windows read only their days.

    The rebalance hint gathers each day's rows into files of the advisory size, and splits the
    days that are too large for one task.
    """
    columns = log.select(*PREPARED_LOG.fieldNames())
    if fmt == CSV:
        columns.write.csv(path, header=True)
    else:
        columns.hint("rebalance", "day").write.partitionBy("day").parquet(path)


def read_prepared(
    spark: SparkSession, path: str, fmt: str = PARQUET, cfg: FeatureConfig | None = None
) -> DataFrame:
    """The prepared log; with ``cfg`` only the days its training and score windows need."""
    log = _read(spark, path, PREPARED_LOG, fmt)
    if cfg is None:
        return log
    first, last = day_range(label_days(cfg, TRAIN) + label_days(cfg, SCORE))
    return log.filter(F.col("day").between(F.lit(first), F.lit(last)))


def write_features(frame: DataFrame, path: str, fmt: str = PARQUET) -> None:
    if fmt == CSV:
        frame.write.csv(path, header=True)
    else:
        frame.write.parquet(path)


def read_features(
    spark: SparkSession,
    path: str,
    with_label: bool,
    fmt: str = PARQUET,
    cfg: FeatureConfig | None = None,
) -> DataFrame:
    cfg = cfg or FeatureConfig()
    return _read(spark, path, features_schema(with_label, cfg.sub_windows, cfg.extras), fmt)


def write_submission(ranked: DataFrame, path: str, with_prob: bool = False) -> None:
    """The ranked pairs as CSV with a header. A top-K result is one short partition."""
    names = [*SUBMISSION.fieldNames(), *(["prob"] if with_prob else [])]
    ranked.select(*names).write.csv(path, header=True)


def read_submission(spark: SparkSession, path: str, with_prob: bool = False) -> DataFrame:
    prob = [T.StructField("prob", T.DoubleType())] if with_prob else []
    return _read(spark, path, T.StructType([*SUBMISSION.fields, *prob]), CSV)

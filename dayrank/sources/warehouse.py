"""A behaviour log out of the ``events`` and ``part`` tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayrank.config import FeatureConfig
from dayrank.operators.prepare import prepare_log
from dayrank.operators.skew import lookup_join
from dayrank.schema import RAW_LOG

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
PART = T.StructType([
    T.StructField("p_partkey", T.LongType()),
    T.StructField("p_name", T.StringType()),
    T.StructField("p_brand", T.StringType()),
    T.StructField("p_type", T.StringType()),
    T.StructField("p_size", T.IntegerType()),
    T.StructField("p_retailprice", T.DoubleType()),
])

# Event type -> behaviour code; other types are no behaviour.
EVENT_BEHAVIOUR = {"click": 1, "view": 2, "signup": 3, "purchase": 4}
# Fixed value: parts up to this size are the items of interest.
MAX_ITEM_SIZE = 40

#: The days of the generated events: last label day and the gap inside its look-back.
EVENTS_CONFIG = FeatureConfig(
    last_label_day=date(2024, 1, 30),
    gap_days=(date(2024, 1, 23), date(2024, 1, 24)),
)


def raw_log(spark: SparkSession, folder: str, cfg: FeatureConfig = EVENTS_CONFIG) -> DataFrame:
    """Events as a raw behaviour log; the item comes from ``props``, its category from
    ``part``."""
    kind = F.col("event_type")
    behaviour = F.lit(None).cast("int")
    for name, code in EVENT_BEHAVIOUR.items():
        behaviour = F.when(kind == name, code).otherwise(behaviour)
    events = (
        spark.read.schema(EVENTS)
        .parquet(f"{folder}/events.parquet")
        .filter(kind.isin(*EVENT_BEHAVIOUR))
        .select(
            "user_id",
            F.get_json_object("props", "$.k").cast("long").alias("item_id"),
            behaviour.alias("behavior_type"),
            # Event times carry no zone: day and hour are as written, whatever the session's.
            F.substring(F.col("ts").cast("string"), 1, 13).alias("time"),
        )
    )
    categories = (
        spark.read.schema(PART)
        .parquet(f"{folder}/part.parquet")
        .select(
            F.col("p_partkey").alias("item_id"),
            F.split("p_brand", "#")[1].cast("long").alias("item_category"),
        )
    )
    joined = lookup_join(events, categories, "item_id", ["user_id", "time"], cfg, "inner")
    return joined.select(*RAW_LOG.fieldNames())


def item_list(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.schema(PART)
        .parquet(f"{folder}/part.parquet")
        .filter(F.col("p_size") <= MAX_ITEM_SIZE)
        .select(F.col("p_partkey").alias("item_id"))
    )


def prepared_log(
    spark: SparkSession, folder: str, cfg: FeatureConfig = EVENTS_CONFIG
) -> DataFrame:
    return prepare_log(raw_log(spark, folder, cfg), item_list(spark, folder), cfg)

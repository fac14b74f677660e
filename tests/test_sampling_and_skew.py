from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.operators.sampling import downsample
from dayrank.operators.skew import lookup_join, measured_keys, spread_join

CFG = FeatureConfig()


def frame(spark, positives: int, negatives: int, partitions: int = 4):
    return (
        spark.range(0, positives + negatives, 1, partitions)
        .select(
            F.lit(date(2014, 12, 1)).alias("label_day"),
            (F.col("id") % 97).alias("user_id"),
            F.col("id").alias("item_id"),
            (F.col("id") < positives).cast("int").alias("label"),
            F.lit(1.5).alias("feature"),
        )
    )


@pytest.mark.parametrize(
    "positives, negatives, kept",
    [(3, 5000, 270), (1, 90, 90), (1, 89, 89), (2, 181, 180), (0, 50, 0), (4, 0, 0), (100, 20, 20)],
)
def test_exact_number_of_negatives(spark, positives, negatives, kept):
    found = downsample(frame(spark, positives, negatives), CFG)
    counts = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    assert counts.get(1, 0) == positives
    assert counts.get(0, 0) == kept


def test_choice_does_not_depend_on_partitioning(spark):
    one = downsample(frame(spark, 5, 3000, 1), CFG)
    many = downsample(frame(spark, 5, 3000, 13).repartition(7, "user_id"), CFG)
    assert sorted(one.collect()) == sorted(many.collect())


def test_seed_changes_the_choice(spark):
    data = frame(spark, 5, 3000)
    one = {r["item_id"] for r in downsample(data, CFG).collect()}
    other = {r["item_id"] for r in downsample(data, replace(CFG, seed=11)).collect()}
    assert len(one) == len(other) == 455 and one != other


def skewed(spark):
    """Key 0 holds a third of the rows."""
    return spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") % 7).alias("g"),
        F.col("id").alias("row"),
    )


def hot_keys(large, keys, cfg):
    return measured_keys(large, [tuple(keys)], cfg)[tuple(keys)][1]


def test_keys_and_hot_keys_are_counted(spark):
    large = skewed(spark)
    found = measured_keys(large, [("k",), ("g",), ("k", "g")], replace(CFG, hot_rows=400))
    assert [found[keys][0] for keys in (("k",), ("g",), ("k", "g"))] == [50, 7, 350]
    assert [tuple(r) for r in found[("k",)][1].collect()] == [(0, 3)]
    assert sorted(tuple(r) for r in found[("g",)][1].collect()) == [(g, 2) for g in range(7)]
    assert found[("k", "g")][1] is None
    assert measured_keys(large, [("k",)], CFG) == {("k",): (50, None)}
    assert measured_keys(large.limit(0), [("k",)], CFG) == {("k",): (0, None)}


@pytest.mark.parametrize("n", [1, 5, 40, 3000])
def test_equally_hot_keys_are_all_spread_or_none(spark, n):
    """A key above its share of a task is spread, however many there are of them; where each of
    thousands has less than a fraction of a task there is no skew."""
    large = spark.range(0, 6000, 1, 6).select((F.col("id") % n).alias("k"), "id")
    limit = 6000 // (CFG.hot_share * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = hot_keys(large, ["k"], replace(CFG, hot_rows=1))
    rows = [] if hot is None else hot.collect()
    assert len(rows) == (n if 6000 // n > limit else 0)
    assert sum(r["copies"] for r in rows) <= 2 * 6000 // limit


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_spread_join_equals_plain_join(spark, how):
    left = skewed(spark)
    right = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = hot_keys(left, ["k"], replace(CFG, hot_rows=20))
    found = spread_join(left, right, ["k"], hot, ["row"], how)
    assert sorted(map(str, found.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_spread_join_splits_the_hot_key(spark):
    left = skewed(spark)
    right = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = hot_keys(left, ["k"], replace(CFG, hot_rows=100))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(left, right, ["k"], hot, ["row"])
        parts = joined.filter("k = 0").select(F.spark_partition_id().alias("p")).distinct()
        plain = left.join(right, "k", "left").filter("k = 0")
        assert plain.select(F.spark_partition_id().alias("p")).distinct().count() == 1
        assert parts.count() > 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_lookup_join_beyond_the_broadcast_limit(spark, how):
    left = skewed(spark)
    right = spark.range(0, 30).select(F.col("id").alias("k"))
    small = lookup_join(left, right, "k", ["row"], CFG, how)
    large = lookup_join(left, right, "k", ["row"], replace(CFG, broadcast_values=3, hot_rows=50), how)
    assert sorted(small.collect()) == sorted(large.collect())

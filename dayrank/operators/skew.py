"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.functions import literal_table


def measured_keys(
    large: DataFrame, key_sets: Sequence[tuple[str, ...]], cfg: FeatureConfig
) -> dict[tuple[str, ...], tuple[int, DataFrame | None]]:
    """Of several key sets the number of keys, and the hot keys with the tasks to spread each over.

    Hot is relative to the data, see ``FeatureConfig.hot_rows``, so by arithmetic at most
    ``hot_share`` x shuffle partitions keys of a key set reach the driver. They come as a literal
    table, or as None where no key is hot, so that a plan without skew carries no trace of this.
    """
    spark = large.sparkSession
    columns = sorted({c for keys in key_sets for c in keys})
    counted = large.groupingSets([list(keys) for keys in key_sets], *columns).agg(
        F.grouping_id().alias("key_set"), F.count(F.lit(1)).alias("rows")
    )
    sizes = {
        r["key_set"]: (r["keys"], r["total"])
        for r in counted.groupBy("key_set")
        .agg(F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("total"))
        .collect()
    }
    total = max((total for _, total in sizes.values()), default=0)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(cfg.hot_rows, total // (cfg.hot_share * partitions))
    # Where not even all rows together could make a hot key there is nothing to look for.
    found = counted.filter(F.col("rows") > limit).collect() if total > limit else []
    out: dict[tuple[str, ...], tuple[int, DataFrame | None]] = {}
    for keys in key_sets:
        # grouping_id has a bit set for every column that is not part of the key set.
        key_set = int("".join("0" if c in keys else "1" for c in columns), 2)
        # A null key joins nothing, so there is nothing to spread.
        rows = [
            (*(f"{r[k]}L" for k in keys), -(-r["rows"] // limit))
            for r in found
            if r["key_set"] == key_set and all(r[k] is not None for k in keys)
        ]
        hot = literal_table(spark, [*keys, "copies"], rows) if rows else None
        out[keys] = sizes.get(key_set, (0, 0))[0], hot
    return out


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    hot: DataFrame | None,
    spread_by: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Equi-join in which the rows of a hot left key go to several tasks.

    A hot key's left rows get a salt from a hash of ``spread_by``; its right rows are copied
    once per salt. Every left row meets exactly the copies with its own salt, so the result is
    that of the plain join. ``right`` is unique on ``on``, or ``how`` is left_semi, so copies
    are few: their number grows with a key's share. ``hot`` (its key columns are among ``on``) is
    bounded by the number of partitions, which is why it may be broadcast.
    """
    on = list(on)
    if hot is None:
        return left.join(right, on, how)
    keys = [c for c in hot.columns if c != "copies"]
    hot = F.broadcast(hot)
    copies = F.coalesce(F.col("copies"), F.lit(1))
    salted = left.join(hot, keys, "left").withColumn(
        "salt", F.pmod(F.xxhash64(*spread_by), copies).cast("int")
    )
    copied = right.join(hot, keys, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), copies - 1))
    )
    return salted.drop("copies").join(copied.drop("copies"), [*on, "salt"], how).drop("salt")


def fits(rows: int, columns: int, cfg: FeatureConfig) -> bool:
    """Whether a counted table may be broadcast."""
    return rows * columns <= cfg.broadcast_values


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: Sequence[str],
    cfg: FeatureConfig,
    how: str,
) -> DataFrame:
    """Join a large log with a lookup table (unique on ``key`` unless ``how`` is left_semi).

    The table is counted first: as long as it ``fits`` it is broadcast and the log is not
    shuffled at all; beyond that the join is shuffled, with hot keys spread.
    """
    if fits(right.count(), len(right.columns), cfg):
        return left.join(F.broadcast(right), key, how)
    hot = measured_keys(left, [(key,)], cfg)[(key,)][1]
    return spread_join(left, right, [key], hot, spread_by, how)

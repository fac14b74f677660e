"""Blocks for the keys touched on a sample day, by rolling sums over daily rows.

A training or score row only ever meets block rows of its own sample day. For those the
one-day families are the daily row itself, and the longer windows are range frames ending at
it: one sort per key, no spreading of days over label days. A key has at most one row per day,
so no window partition grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.functions import aliased
from dayrank.operators.label_calendar import LabelDay, sample_day_table
from dayrank.schema import BEHAVIOURS, PROFILE_DAYS, PURCHASE, SPAN_ENTITIES, USER, Entity


def sample_day_block(
    daily: DataFrame,
    entity: Entity,
    days: Sequence[LabelDay],
    cfg: FeatureConfig,
    labelled: bool = False,
) -> DataFrame:
    """The entity's block on sample days, its profile still a map.

    With ``labelled`` (the user-item block of a training run) the row also says whether the
    pair is bought on the label day, one day ahead in the same frame order.
    """
    p = entity.prefix
    key = f"PARTITION BY {', '.join(entity.keys)} ORDER BY day_no"
    # Window lengths differ between label days next to the gap, so a window has one frame per
    # length and each row picks the one of its label day.
    lengths = {"long": sorted({d.long_back for d in days})}
    for n in cfg.sub_windows:
        lengths[f"d{n}"] = sorted({d.back(d.sub_from[n]) for d in days})

    rolled = [
        f"sum(n{b}) OVER ({key} RANGE BETWEEN {back} PRECEDING AND CURRENT ROW) AS s{back}_{b}"
        for back in sorted({k for found in lengths.values() for k in found})
        for b in BEHAVIOURS
    ]
    if entity.live:
        rolled += [
            f"count_if(n{b} > 0) OVER ({key} RANGE BETWEEN {back} PRECEDING AND CURRENT ROW)"
            f" AS l{back}_{b}"
            for back in lengths["long"]
            for b in BEHAVIOURS
        ]
    if cfg.extras and entity in SPAN_ENTITIES:
        rolled += [
            f"day_no - min(day_no) OVER ({key} RANGE BETWEEN {back} PRECEDING AND CURRENT ROW)"
            f" AS t{back}_0"
            for back in lengths["long"]
        ]
    if cfg.extras and entity == USER:
        rolled += [
            f"flatten(collect_list(cells) OVER ({key} RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"
            f" AS cells{n}"
            for n in PROFILE_DAYS
        ]
    if labelled:
        rolled.append(
            f"max(n{PURCHASE} > 0) OVER ({key} RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)"
            " AS bought"
        )

    def pick(window: str, stem: str, b: int) -> str:
        *special, usual = lengths[window]
        cases = "".join(f" WHEN {window}_back = {k} THEN {stem}{k}_{b}" for k in special)
        return f"CASE{cases} ELSE {stem}{usual}_{b} END" if special else f"{stem}{usual}_{b}"

    out = {f"{p}_d1_b{b}": f"n{b}" for b in BEHAVIOURS}
    for window in lengths:
        out |= {f"{p}_{window}_b{b}": pick(window, "s", b) for b in BEHAVIOURS}
    if entity.live:
        out |= {f"{entity.live}_days_b{b}": pick("long", "l", b) for b in BEHAVIOURS}
    if entity.hours:
        out |= {f"{p}_hour_{h}": f"hour_{h}" for h in ("min", "max")}
    if entity.type_max:
        out[f"{p}_type_max"] = "type_max"
    if entity.profile:
        out[f"{entity.profile}_cells"] = "map_from_entries(cells)"
    if cfg.extras and entity in SPAN_ENTITIES:
        out[f"{p}_span"] = pick("long", "t", 0)
    if cfg.extras and entity == USER:
        for n in PROFILE_DAYS:
            out[f"{entity.profile}{n}d_cells"] = (
                f"map_from_entries(transform(array_distinct(transform(cells{n}, x -> x.cell)), k -> struct("
                f"k, aggregate(filter(cells{n}, x -> x.cell = k), 0L, (total, x) -> total + x.cnt))))"
            )
    if "item_category" in daily.columns and "item_category" not in entity.keys:
        out["item_category"] = "item_category"
    if labelled:
        out["label"] = "CAST(coalesce(bought, FALSE) AS INT)"
    return (
        daily.withColumn("day_no", F.unix_date("day"))
        .selectExpr("*", *rolled)
        .join(F.broadcast(sample_day_table(daily.sparkSession, days)), "day")
        .selectExpr("label_day", *entity.keys, *aliased(out))
    )

"""Feature tables from a rollup that is laid out by user."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.operators.label_calendar import SCORE, TRAIN, LabelDay, label_days, within_days
from dayrank.operators.layout import ByUser, joined_as_they_lie
from dayrank.operators.rolling import sample_day_block
from dayrank.operators.rollup import daily_counts, daily_profile, entity_cells
from dayrank.operators.skew import fits, measured_keys, spread_join
from dayrank.operators.uniques import unique_users
from dayrank.plans.features import named
from dayrank.schema import (
    CATEGORY,
    ITEM,
    PROFILE_DAYS,
    USER,
    USER_CATEGORY,
    USER_ITEM,
    WITH_IDS,
    block_columns,
)
from dayrank.session import materialize


def placed_train_features(layout: ByUser, cfg: FeatureConfig) -> DataFrame:
    """Labelled samples of all label days with their features. The samples with their pair, context and
    user blocks are written now, as they are joined by a rule of their own."""
    return _features(layout, cfg, TRAIN)


def placed_score_features(layout: ByUser, cfg: FeatureConfig) -> DataFrame:
    """Samples of the last label day with their features."""
    return _features(layout, cfg, SCORE)


def placed_samples(
    rollup: DataFrame, days: list[LabelDay], cfg: FeatureConfig, labelled: bool, placed: bool
) -> tuple[DataFrame, DataFrame]:
    """The samples of some users with their pair, user-category and user blocks; and the daily rows of
    the pairs. Where the rows are placed by user nothing here is moved."""
    pair_days = daily_profile(
        entity_cells(rollup.filter(WITH_IDS), USER_ITEM, placed), USER_ITEM, days, cfg.sample_behaviours
    )
    frame = sample_day_block(pair_days, USER_ITEM, days, cfg, labelled)
    if cfg.sample_behaviours:
        touched = " + ".join(f"ui_d1_b{b}" for b in cfg.sample_behaviours)
        frame = frame.filter(f"{touched} > 0")
    profile_days = max(PROFILE_DAYS) if cfg.extras else 1
    user = sample_day_block(
        daily_profile(entity_cells(rollup, USER, placed), USER, days, None, profile_days), USER, days, cfg
    )
    context = sample_day_block(
        daily_profile(entity_cells(rollup, USER_CATEGORY, placed), USER_CATEGORY, days), USER_CATEGORY, days, cfg
    )
    by_context, by_user = ["label_day", *USER_CATEGORY.keys], ["label_day", *USER.keys]
    if placed:
        # A merge join takes both sides as they lie; a broadcast would gather the block.
        frame = frame.join(context.hint("merge"), by_context, "left").join(user.hint("merge"), by_user, "left")
    else:
        # Hot users: by the bound on their number their own block is small, their categories may be hot.
        hot = measured_keys(
            rollup.filter(F.col("day").isin(*(d.sample_day for d in days))), [USER_CATEGORY.keys], cfg
        )[USER_CATEGORY.keys][1]
        frame = spread_join(frame, context, by_context, hot, USER_ITEM.keys)
        frame = frame.join(F.broadcast(user), by_user, "left")
    return frame, pair_days


def _features(layout: ByUser, cfg: FeatureConfig, as_of: str) -> DataFrame:
    days = label_days(cfg, as_of)
    labelled = as_of == TRAIN
    whole = within_days(layout.whole, days)
    sides = [(layout.bucketed, True)] + [(layout.rest, False)] * layout.has_hot
    parts = [placed_samples(within_days(rows, days), days, cfg, labelled, placed) for rows, placed in sides]
    with joined_as_they_lie(whole.sparkSession):
        parts[0] = materialize(parts[0][0], "placed-samples"), parts[0][1]
    frame = reduce(DataFrame.unionByName, (frame for frame, _ in parts))
    # The two sides share no user, so an item's users add up.
    users = reduce(DataFrame.unionByName, (unique_users(pairs, ITEM, days, cfg) for _, pairs in parts))
    if len(parts) > 1:
        counts = [c for c in users.columns if c not in ("label_day", "item_id")]
        users = users.groupBy("label_day", "item_id").agg(*(F.sum(c).alias(c) for c in counts))

    item = sample_day_block(daily_counts(whole, ITEM.keys), ITEM, days, cfg).join(
        users, ["label_day", "item_id"], "left"
    )
    category = sample_day_block(daily_counts(whole, CATEGORY.keys), CATEGORY, days, cfg)
    on_sample_days = whole.filter(F.col("day").isin(*(d.sample_day for d in days)))
    measured = measured_keys(on_sample_days, [ITEM.keys, CATEGORY.keys], cfg)
    for entity, block in ((CATEGORY, category), (ITEM, item)):
        keys, hot = measured[entity.keys]
        on = ["label_day", *entity.keys]
        if fits(keys * len(days), len(block_columns(entity, cfg.sub_windows)), cfg):
            frame = frame.join(F.broadcast(block), on, "left")
        else:
            frame = spread_join(frame, block, on, hot, USER_ITEM.keys)
    return named(frame, cfg, labelled)

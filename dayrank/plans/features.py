"""Training and score feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrank.config import FeatureConfig
from dayrank.functions import aliased, averages, profile, ratios
from dayrank.operators.distinct_sketches import estimated_users, user_sketches
from dayrank.operators.label_calendar import SCORE, TRAIN, LabelDay, label_days, within_days
from dayrank.operators.rolling import sample_day_block
from dayrank.operators.rollup import daily_counts, daily_profile, entity_cells
from dayrank.operators.samples import samples
from dayrank.operators.sampling import chosen, class_fractions, class_weights, drawn, weighted
from dayrank.operators.skew import fits, measured_keys, spread_join
from dayrank.operators.uniques import unique_users
from dayrank.schema import (
    CATEGORY,
    ITEM,
    PROFILE_DAYS,
    RATIO_WINDOWS,
    SAMPLE_KEY,
    USER,
    USER_CATEGORY,
    USER_ITEM,
    WITH_IDS,
    Entity,
    block_columns,
    feature_columns,
)
from dayrank.session import materialize


def train_features(
    rollup: DataFrame,
    cfg: FeatureConfig,
    days: Sequence[LabelDay] | None = None,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Labelled samples with their 426 features: of all label days, or of ``days``. With
    ``cfg.approximate_users`` distinct users come from ``sketches`` by day, or else from sketches of
    the rollup."""
    return _features(rollup, cfg, TRAIN, days=days, sketches=sketches)


def train_rows(
    rollup: DataFrame,
    cfg: FeatureConfig,
    days: Sequence[LabelDay],
    sketches: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``train_features`` with their joined blocks, as ``named`` reads them: a quarter of the
    columns, so this is what to move."""
    return _joined(rollup, cfg, TRAIN, days=days, sketches=sketches)


def training_set(rollup: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Training features of all positives and the downsampled negatives, with weights where they are
    a Bernoulli sample. The choice needs keys and labels only, so it comes before the joins: dropped
    samples never meet their blocks."""
    found = samples(rollup, label_days(cfg, TRAIN), cfg, labelled=True)
    labels = materialize(found.select(*SAMPLE_KEY, "label"), "labels")
    if cfg.sampling == "bernoulli":
        keep = drawn(class_fractions(labels, cfg), cfg)
        return weighted(_features(rollup, cfg, TRAIN, keep), class_weights(labels, keep))
    return _features(rollup, cfg, TRAIN, chosen(labels, cfg))


def score_features(rollup: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Samples of the last label day with the same features and no label."""
    return _features(rollup, cfg, SCORE)


def _features(
    rollup: DataFrame,
    cfg: FeatureConfig,
    as_of: str,
    keep: Column | None = None,
    days: Sequence[LabelDay] | None = None,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Samples with all blocks, their columns named."""
    return named(_joined(rollup, cfg, as_of, keep, days, sketches), cfg, as_of == TRAIN)


def _joined(
    rollup: DataFrame,
    cfg: FeatureConfig,
    as_of: str,
    keep: Column | None = None,
    days: Sequence[LabelDay] | None = None,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Samples with all blocks, profiles still maps.

    The user-item block *is* the sample frame: a pair is a sample exactly when it has a daily
    row on the sample day, and its label is in the day after. The user and category blocks are
    first joined to the shorter user-category block, so a sample row is moved at most twice, once
    by item and once by user and category, while it is still narrow. A block whose counted size
    allows it is broadcast and moves no rows at all.

    ``rollup`` is read by every block: hand in a materialized one, partitioned by day.
    """
    days = label_days(cfg, as_of) if days is None else list(days)
    rollup = within_days(rollup, days)
    labelled = as_of == TRAIN

    on_sample_days = rollup.filter(F.col("day").isin(*(d.sample_day for d in days)))
    measured = measured_keys(
        on_sample_days, [e.keys for e in (USER, ITEM, CATEGORY, USER_CATEGORY)], cfg
    )

    def seen(daily: DataFrame, entity: Entity) -> DataFrame:
        """With a single sample day only keys active on it have a row in the end; dropping the
        others here keeps them out of the windows. The keys of many days are nearly all."""
        if len(days) > 1:
            return daily
        keys = on_sample_days.select(*entity.keys).distinct()
        return daily.join(keys, list(entity.keys), "left_semi")

    # A pair needs both ids, other blocks count every row of their key. Both readers of the pairs
    # start from the same frame, so that they share one shuffle.
    pair_days = daily_profile(
        entity_cells(rollup.filter(WITH_IDS), USER_ITEM), USER_ITEM, days, cfg.sample_behaviours
    )
    frame = sample_day_block(seen(pair_days, USER_ITEM), USER_ITEM, days, cfg, labelled)
    if cfg.sample_behaviours:
        touched = " + ".join(f"ui_d1_b{b}" for b in cfg.sample_behaviours)
        frame = frame.filter(f"{touched} > 0")
    if keep is not None:
        frame = frame.filter(keep)

    if cfg.approximate_users:
        users = estimated_users(user_sketches(rollup, cfg) if sketches is None else sketches, days, cfg)
    else:
        users = unique_users(pair_days, ITEM, days, cfg)
    item = sample_day_block(daily_counts(rollup, ITEM.keys), ITEM, days, cfg).join(
        users, ["label_day", "item_id"], "left"
    )
    category = sample_day_block(daily_counts(rollup, CATEGORY.keys), CATEGORY, days, cfg)
    profile_days = max(PROFILE_DAYS) if cfg.extras else 1
    user = sample_day_block(
        seen(daily_profile(entity_cells(rollup, USER), USER, days, None, profile_days), USER),
        USER,
        days,
        cfg,
    )
    context = sample_day_block(
        seen(daily_profile(entity_cells(rollup, USER_CATEGORY), USER_CATEGORY, days), USER_CATEGORY),
        USER_CATEGORY,
        days,
        cfg,
    )

    def joined(left: DataFrame, block: DataFrame, entity: Entity, spread_by: tuple[str, ...]) -> DataFrame:
        """A block has at most a row for each of the counted keys and label day. As long as that
        is small it goes to the rows and they stay where they are."""
        on = ["label_day", *entity.keys]
        keys, hot = measured[entity.keys]
        width = len(block_columns(entity, cfg.sub_windows))
        if fits(keys * len(days), width, cfg):
            return left.join(F.broadcast(block), on, "left")
        return spread_join(left, block, on, hot, spread_by)

    for entity, block in ((CATEGORY, category), (USER, user)):
        context = joined(context, block, entity, USER_CATEGORY.keys)
    for entity, block in ((ITEM, item), (USER_CATEGORY, context)):
        frame = joined(frame, block, entity, USER_ITEM.keys)
    return frame


def named(frame: DataFrame, cfg: FeatureConfig, labelled: bool) -> DataFrame:
    """The fixed column list: derived features added, profiles expanded, nulls filled."""
    derived = {"u_hour_range": "u_hour_max - u_hour_min"}
    for entity in (USER, ITEM, CATEGORY):
        p = entity.prefix
        derived |= averages(f"{p}_long", f"{p}_avg", cfg.slot)
        derived |= ratios(f"{p}_long", f"{p}_ratio")
    for entity in (USER, USER_ITEM, USER_CATEGORY):
        derived |= profile(f"{entity.profile}_cells", entity.profile)
    if cfg.extras:
        for p in (e.prefix for e in (USER, ITEM, CATEGORY)):
            for n in RATIO_WINDOWS:
                derived |= ratios(f"{p}_d{n}", f"{p}_d{n}_ratio")
        for n in PROFILE_DAYS:
            derived |= profile(f"{USER.profile}{n}d_cells", f"{USER.profile}{n}d")
    ids = [*SAMPLE_KEY, "item_category", *(["label"] if labelled else [])]
    features = {
        c: f"coalesce({derived.get(c, c)}, 0)" for c in feature_columns(cfg.sub_windows, cfg.extras)
    }
    return frame.selectExpr(*ids, *aliased(features))

"""One named query per operator, over the whole ``events`` and ``part`` tables of a folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import date

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrank.functions import add_purchase_flag
from dayrank.operators import blocks, calendar_data
from dayrank.operators.calendar_data import calendar_rows
from dayrank.operators.distinct_sketches import compare, estimated_users, user_sketches
from dayrank.operators.evaluate import actual_pairs, best_per_pair, evaluate_every_k
from dayrank.operators.label_calendar import (
    SCORE,
    TRAIN,
    LabelDay,
    label_days,
    membership,
    spine,
    within_days,
)
from dayrank.operators.layout import by_user
from dayrank.operators.model import load_model, predict, save_model, train, vectors
from dayrank.operators.prepare import long_window, one_day_slice, prepare_log, purchases
from dayrank.operators.quarantine import accepted, counts, quarantined
from dayrank.operators.ranking import top_k, whole_ranking, with_activity_score
from dayrank.operators.rollup import base_rollup, daily_counts, is_pair, unit_rollup
from dayrank.operators.samples import samples, samples_per_day
from dayrank.operators.sampling import bernoulli, downsample
from dayrank.operators.uniques import unique_users
from dayrank.plans.features import score_features, train_features, training_set
from dayrank.plans.jobs import evaluate_frame, rank_frame
from dayrank.plans.placed import placed_train_features
from dayrank.plans.store import features_table, update, window_days
from dayrank.schema import (
    CATEGORY,
    ENTITIES,
    ITEM,
    SAMPLE_KEY,
    USER,
    USER_CATEGORY,
    USER_ITEM,
    Entity,
    feature_columns,
)
from dayrank.session import fresh_path, materialize, tune
from dayrank.sources import behaviour as io
from dayrank.sources.warehouse import EVENTS_CONFIG, item_list, prepared_log, raw_log

Query = Callable[[SparkSession, str], DataFrame]

CFG = EVENTS_CONFIG
#: Evaluation needs a following day in the data, so it scores an earlier day.
EVALUATION_CFG = replace(CFG, last_label_day=date(2024, 1, 21))
#: Samples from collecting and viewing only.
SUBSET_CFG = replace(CFG, sample_behaviours=(3, 2))
TRAIN_DAYS = label_days(CFG, TRAIN)
SCORE_DAYS = label_days(CFG, SCORE)
#: Rankings of the whole training frame break ties over all of the key.
ALL_TIES = SAMPLE_KEY


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return prepared_log(tune(spark), folder, CFG)


def _rollup(spark: SparkSession, folder: str, entity: Entity) -> DataFrame:
    """What a single block is counted from."""
    log = _log(spark, folder)
    return base_rollup(log) if is_pair(entity.keys) or entity.unique_users else unit_rollup(log)


def _shared_rollup(spark: SparkSession, folder: str, days: Sequence[LabelDay]) -> DataFrame:
    """What all blocks of a feature table are counted from: the days it needs, stored by day."""
    return materialize(base_rollup(within_days(_log(spark, folder), days)), "rollup", "day")


def label_spine(spark: SparkSession, folder: str) -> DataFrame:
    """Window dates of each label day, with the log rows that fall into each window."""
    per_day = _log(spark, folder).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    flags = {f"d{n}": f"in_d{n}" for n in sorted(CFG.sub_windows)}
    members = membership(spark, TRAIN_DAYS, CFG)
    counted = (
        per_day.join(F.broadcast(members), "day")
        .groupBy("label_day")
        .agg(
            F.count(F.lit(1)).alias("long_days"),
            F.sum("n").alias("long_rows"),
            F.sum(F.when(F.col("in_d1"), F.col("n")).otherwise(0)).alias("d1_rows"),
            *(
                F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(f"{name}_rows")
                for name, flag in flags.items()
            ),
        )
    )
    return spine(spark, TRAIN_DAYS).join(counted, "label_day", "left")


def _samples(labelled: bool, cfg=CFG) -> Query:
    days = TRAIN_DAYS if labelled else SCORE_DAYS
    return lambda spark, folder: samples(_log(spark, folder), days, cfg, labelled)


def _counts(entity: Entity, window: str) -> Query:
    return lambda spark, folder: blocks.window_counts(
        _rollup(spark, folder, entity), entity, window, TRAIN_DAYS, CFG
    )


def _averages(entity: Entity) -> Query:
    counts = _counts(entity, "long")
    return lambda spark, folder: blocks.window_averages(counts(spark, folder), entity, CFG)


def _ratios(entity: Entity, window: str) -> Query:
    counts = _counts(entity, window)
    return lambda spark, folder: blocks.window_ratios(counts(spark, folder), entity, window)


def _extremes(entity: Entity, columns: tuple[str, ...]) -> Query:
    names = [f"{entity.prefix}_{c}" for c in columns]
    return lambda spark, folder: blocks.one_day_extremes(
        _log(spark, folder), entity, TRAIN_DAYS, CFG
    ).select("label_day", *entity.keys, *names)


def _profile(entity: Entity, n: int = 1) -> Query:
    return lambda spark, folder: blocks.hour_profile(
        _rollup(spark, folder, entity), entity, TRAIN_DAYS, CFG, n
    )


def _block(entity: Entity) -> Query:
    return lambda spark, folder: blocks.entity_block(
        _rollup(spark, folder, entity), entity, TRAIN_DAYS, CFG
    )


def _span(entity: Entity) -> Query:
    return lambda spark, folder: blocks.touch_span(_log(spark, folder), entity, TRAIN_DAYS, CFG)


def _train_features(spark: SparkSession, folder: str) -> DataFrame:
    return train_features(_shared_rollup(spark, folder, TRAIN_DAYS), CFG)


def _score_features(spark: SparkSession, folder: str) -> DataFrame:
    return score_features(_shared_rollup(spark, folder, SCORE_DAYS), CFG)


def _train_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors(_train_features(spark, folder), CFG)
    values = vector_to_array("features")
    return found.select(
        *SAMPLE_KEY,
        "label",
        F.size(values).alias("n_features"),
        F.size(F.filter(values, lambda v: v != 0)).alias("n_nonzero"),
        F.round(F.aggregate(values, F.lit(0.0), lambda total, v: total + v), 6).alias("total"),
        F.round(
            F.aggregate(
                F.transform(values, lambda v, at: v * (at + 1)), F.lit(0.0), lambda total, v: total + v
            ),
            5,
        ).alias("weighted"),
    )


def _top(k: int) -> Query:
    return lambda spark, folder: top_k(
        with_activity_score(_train_features(spark, folder)), k, ties=ALL_TIES
    )


def _submission(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "submission")
    io.write_submission(_top(CFG.top_k)(spark, folder), path)
    return io.read_submission(spark, path)


def _gbt_rank(spark: SparkSession, folder: str) -> DataFrame:
    rollup = _shared_rollup(spark, folder, TRAIN_DAYS + SCORE_DAYS)
    return rank_frame(training_set(rollup, CFG), score_features(rollup, CFG), CFG)


def _gbt_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for a ranking whatever the model's numbers are, as one row of counts."""
    rollup = _shared_rollup(spark, folder, TRAIN_DAYS + SCORE_DAYS)
    training = materialize(training_set(rollup, CFG), "training-set")
    scored = materialize(predict(train(training, CFG), score_features(rollup, CFG), CFG), "scored")
    ranked = top_k(scored, CFG.top_k)
    probabilities = F.collect_list("prob")  # at most top_k of them, in order
    rising = F.size(
        F.filter(
            F.transform("p", lambda p, at: p > F.get("p", at - 1)), lambda rises: rises
        )
    )
    return (
        scored.agg(
            F.count(F.lit(1)).alias("n_scored"),
            F.count_distinct("user_id", "item_id").alias("n_pairs"),
            F.count_if(F.col("label_day") != F.lit(CFG.last_label_day)).alias("n_other_days"),
            F.count_if(~F.col("prob").between(0, 1)).alias("n_not_probabilities"),
            F.lit(1).alias("one"),
        )
        .join(ranked.agg(probabilities.alias("p"), F.lit(1).alias("one")), "one")
        .join(
            training.agg(
                F.count_if(F.col("label") == 1).alias("n_positives"),
                F.count(F.lit(1)).alias("n_training"),
                F.lit(1).alias("one"),
            ),
            "one",
        )
        .select(
            "n_scored",
            "n_pairs",
            "n_other_days",
            "n_not_probabilities",
            F.size("p").cast("long").alias("n_ranked"),
            rising.cast("long").alias("n_rising"),
            "n_positives",
            "n_training",
        )
    )


def _evaluate(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates of a day against the purchases of the next: two filtered scans."""
    log = _log(spark, folder)
    predicted = samples(log, label_days(EVALUATION_CFG, SCORE), EVALUATION_CFG, False)
    return evaluate_frame(predicted, log, EVALUATION_CFG)


def _evaluate_best(repeated: bool) -> Query:
    """The best pairs only; with ``repeated`` each pair is predicted twice with other scores."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        days = label_days(EVALUATION_CFG, SCORE)
        rollup = _shared_rollup(spark, folder, days)
        scored = with_activity_score(score_features(rollup, EVALUATION_CFG))
        if repeated:
            other = scored.withColumn("prob", (F.col("user_id") % 7 * 10).cast("double"))
            scored = best_per_pair(scored.unionByName(other))
        return evaluate_frame(top_k(scored, 50), _log(spark, folder), EVALUATION_CFG)

    return run


def _io_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Write each table, read it back, and give rows and totals over all columns per day. The raw
    log and the items go through their CSV readers first."""
    tune(spark)
    names = ("raw", "items", "prepared", "prepared_csv", "train", "train_csv", "score")
    paths = {name: fresh_path(spark, name) for name in names}
    raw_log(spark, folder, CFG).write.csv(paths["raw"], header=True)
    item_list(spark, folder).write.csv(paths["items"], header=True)
    log = prepare_log(io.read_raw_log(spark, paths["raw"]), io.read_items(spark, paths["items"]), CFG)
    io.write_prepared(log, paths["prepared"])
    io.write_prepared(log, paths["prepared_csv"], io.CSV)
    prepared = io.read_prepared(spark, paths["prepared"])
    rollup = materialize(base_rollup(prepared), "rollup", "day")
    io.write_features(train_features(rollup, CFG), paths["train"])
    io.write_features(io.read_features(spark, paths["train"], True), paths["train_csv"], io.CSV)
    io.write_features(score_features(rollup, CFG), paths["score"])
    features = feature_columns(CFG.sub_windows)
    weighted = " + ".join(f"{at} * CAST({c} AS DOUBLE)" for at, c in enumerate(features, 1))
    score = f"CAST(item_category AS DOUBLE) + {weighted}"
    train = f"{score} + {len(features) + 1} * CAST(label AS DOUBLE)"
    row = "CAST(hour + 100 * behavior_type + 1000 * item_category AS DOUBLE)"
    tables = {
        "prepared": (prepared, "day", row),
        "prepared_csv": (io.read_prepared(spark, paths["prepared_csv"], io.CSV), "day", row),
        "train": (io.read_features(spark, paths["train"], True), "label_day", train),
        "train_csv": (io.read_features(spark, paths["train_csv"], True, io.CSV), "label_day", train),
        "score": (io.read_features(spark, paths["score"], False), "label_day", score),
    }
    parts = [
        table.groupBy(F.col(day).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("user_id").alias("user_total"),
            F.sum("item_id").alias("item_total"),
            F.round(F.sum(F.expr(value)), 2).alias("value_total"),
        )
        .select(F.lit(name).alias("sink"), "*")
        for name, (table, day, value) in tables.items()
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _exact_users(spark: SparkSession, folder: str) -> DataFrame:
    pairs = daily_counts(_rollup(spark, folder, USER_ITEM), USER_ITEM.keys)
    return unique_users(pairs, ITEM, TRAIN_DAYS, CFG)


def _sketched_users(spark: SparkSession, folder: str) -> DataFrame:
    """How far distinct users by merged daily sketches are from the exact ones: no item further off than
    four standard errors."""
    stored = materialize(user_sketches(_log(spark, folder), CFG), "sketches", "day")
    return compare(_exact_users(spark, folder), estimated_users(stored, TRAIN_DAYS, CFG), CFG)


def _bernoulli(spark: SparkSession, folder: str) -> DataFrame:
    """All positives and each negative with the same chance, with weights."""
    return bernoulli(materialize(_samples(True)(spark, folder), "samples"), CFG)


def _train_features_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Features of a store that was made for a calendar two label days ago and then brought up to date day
    by day; the first day of the last window is delivered twice, the first time without its purchases."""
    log = materialize(_log(spark, folder), "prepared", "day")
    path = fresh_path(spark, "store")
    late = TRAIN_DAYS[0].long_from
    early = log.filter((F.col("day") != F.lit(late)) | (F.col("behavior_type") != 4))
    newest = [d.label_day for d in TRAIN_DAYS[:2]]
    before = replace(CFG, last_label_day=TRAIN_DAYS[2].label_day)
    log_days = window_days(label_days(before, TRAIN))
    known = update(path, early, log_days, before)
    for day in sorted(newest):
        now = replace(CFG, last_label_day=day)
        new = [d for d in window_days(label_days(now, TRAIN)) if d not in log_days]
        update(path, early, new, now, known)
        log_days, known = log_days + new, [d.label_day for d in label_days(now, TRAIN)]
    update(path, log, [late], CFG, known)
    return features_table(spark, path, CFG)


def _calendar(spark: SparkSession) -> DataFrame:
    """The calendars of training and scoring as a stored table, of which training's is read."""
    both = calendar_rows(spark, "train", TRAIN_DAYS, CFG).unionByName(
        calendar_rows(spark, "score", SCORE_DAYS, CFG)
    )
    return materialize(both, "calendar").filter(F.col("run") == "train")


def _by_calendar(use: Callable[[DataFrame, DataFrame], DataFrame], counted: bool = False) -> Query:
    """A query over the log, or its rollup, stored by day, and a stored calendar."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        log = _log(spark, folder)
        return use(materialize(base_rollup(log) if counted else log, "by-day", "day"), _calendar(spark))

    return run


def _train_features_placed(spark: SparkSession, folder: str) -> DataFrame:
    rollup = _shared_rollup(spark, folder, TRAIN_DAYS)
    return placed_train_features(by_user(rollup, CFG), CFG)


def _quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """A raw log in which some users, times and hours are made unreadable, written as CSV and read back:
    rows taken, and rows quarantined by reason."""
    path = fresh_path(spark, "raw")
    raw = raw_log(tune(spark), folder, CFG)
    turn = (F.col("user_id") + F.col("item_id")) % 40
    broken = raw.withColumns({
        "user_id": F.when(turn == 1, F.concat(F.lit("u"), F.col("user_id"))).otherwise(F.col("user_id").cast("string")),
        "time": F.when(turn == 2, F.lit("yesterday"))
        .when(turn == 3, F.concat(F.substring("time", 1, 11), F.lit("31")))
        .when(turn == 4, F.lit(None))
        .otherwise(F.col("time")),
    })
    broken.write.csv(path, header=True)
    rows = io.read_raw_log_checked(spark, path)
    taken = accepted(rows).agg(F.lit("taken").alias("reason"), F.count(F.lit(1)).alias("n_rows"))
    return taken.unionByName(counts(quarantined(rows)))


def _gbt_stored(spark: SparkSession, folder: str) -> DataFrame:
    """A model scored as it was trained, and after it was stored and loaded: rows, and rows whose
    probability differs."""
    rollup = _shared_rollup(spark, folder, TRAIN_DAYS + SCORE_DAYS)
    scoring = materialize(score_features(rollup, CFG), "scoring")
    model = train(materialize(training_set(rollup, CFG), "training-set"), CFG)
    path = fresh_path(spark, "model")
    save_model(model, path, CFG)
    found = predict(load_model(spark, path, CFG), scoring, CFG).withColumnRenamed("prob", "stored")
    both = predict(model, scoring, CFG).join(found, list(SAMPLE_KEY))
    return both.agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.count_if(~F.col("prob").eqNullSafe(F.col("stored"))).alias("n_different"),
    )


def _ranking_all(spark: SparkSession, folder: str) -> DataFrame:
    scored = materialize(with_activity_score(_train_features(spark, folder)), "scored")
    return whole_ranking(scored, ties=ALL_TIES)


def _evaluate_every_k(spark: SparkSession, folder: str) -> DataFrame:
    rollup = _shared_rollup(spark, folder, label_days(EVALUATION_CFG, SCORE))
    scored = with_activity_score(score_features(rollup, EVALUATION_CFG))
    return evaluate_every_k(scored, actual_pairs(_log(spark, folder), EVALUATION_CFG.last_label_day))


def catalog() -> dict[str, Query]:
    found: dict[str, Query] = {
        "prep_log": _log,
        "label_spine": label_spine,
        "one_day_slice": lambda s, d: one_day_slice(_log(s, d), TRAIN_DAYS, CFG),
        "long_window_train": lambda s, d: long_window(_log(s, d), TRAIN_DAYS, CFG),
        "long_window_score": lambda s, d: long_window(_log(s, d), SCORE_DAYS, CFG),
        "label_purchases": lambda s, d: purchases(_log(s, d)).filter(
            F.col("day").isin(*(x.label_day for x in TRAIN_DAYS))
        ),
        "purchase_flag": lambda s, d: add_purchase_flag(
            one_day_slice(_log(s, d), TRAIN_DAYS, CFG)
        ),
        "train_samples": lambda s, d: _samples(True)(s, d).drop("label"),
        "train_labels": _samples(True),
        "samples_subset": _samples(True, SUBSET_CFG),
        "score_samples": _samples(False),
        "samples_per_day": lambda s, d: samples_per_day(_samples(True)(s, d)),
    }
    for entity in ENTITIES:
        for window in ("long", "d1", "d5", "d3", "d7"):
            found[f"cnt_{entity.name}_{window}"] = _counts(entity, window)
    for entity in (USER, ITEM, CATEGORY):
        found[f"avg_{entity.name}"] = _averages(entity)
        found[f"ratio_{entity.name}"] = _ratios(entity, "long")
        found[f"ratio_d5_{entity.name}"] = _ratios(entity, "d5")
        found[f"ratio_d3_{entity.name}"] = _ratios(entity, "d3")
    found["uniq_users_item"] = _exact_users
    found["hours_user"] = _extremes(USER, ("hour_min", "hour_max", "hour_range"))
    for entity in (USER_ITEM, USER_CATEGORY):
        found[f"hours_{entity.name}"] = _extremes(entity, ("hour_min", "hour_max"))
        found[f"type_max_{entity.name}"] = _extremes(entity, ("type_max",))
        found[f"span_{entity.name}"] = _span(entity)
    for entity in (USER, USER_ITEM, USER_CATEGORY):
        found[f"hour_profile_{entity.name}"] = _profile(entity)
    found["hour_profile_user_2d"] = _profile(USER, 2)
    found["hour_profile_user_5d"] = _profile(USER, 5)
    found["live_days_user"] = lambda s, d: blocks.live_days(
        _rollup(s, d, USER), USER, TRAIN_DAYS, CFG
    )
    for entity in ENTITIES:
        found[f"feat_{entity.name}"] = _block(entity)
    found |= {
        "train_features": _train_features,
        "score_features": _score_features,
        "train_features_extras": lambda s, d: train_features(
            _shared_rollup(s, d, TRAIN_DAYS), replace(CFG, extras=True)
        ),
        "train_vectors": _train_vectors,
        "downsample": lambda s, d: downsample(materialize(_samples(True)(s, d), "samples"), CFG),
        "topk_700": _top(700),
        "topk_900": _top(900),
        "submission": _submission,
        "gbt_rank": _gbt_rank,
        "gbt_checks": _gbt_checks,
        "evaluate": _evaluate,
        "evaluate_top": _evaluate_best(False),
        "evaluate_repeated": _evaluate_best(True),
        "io_roundtrip": _io_roundtrip,
        "uniq_users_item_sketch": _sketched_users,
        "downsample_bernoulli": _bernoulli,
        "train_features_incremental": _train_features_incremental,
        "long_window_calendar": _by_calendar(calendar_data.long_window),
        "train_labels_calendar": _by_calendar(lambda log, days: calendar_data.samples(log, days, CFG)),
        "train_features_placed": _train_features_placed,
        "quarantine": _quarantine,
        "gbt_stored": _gbt_stored,
        "ranking_all": _ranking_all,
        "evaluate_every_k": _evaluate_every_k,
    }
    for entity in (USER, USER_ITEM):
        found[f"cnt_{entity.name}_calendar"] = _by_calendar(
            lambda rollup, days, e=entity: calendar_data.window_counts(rollup, e, "long", days), counted=True
        )
    return found

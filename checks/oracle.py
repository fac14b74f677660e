"""The catalogue's queries as plain SQL over the ``events`` and ``part`` views.

The SQL counts log rows per window directly (no rollups, no rolling frames) and takes its
calendar from the list of label days below, so it shares no reasoning with the engine.
"""

from __future__ import annotations

LABEL_DAYS = [
    "2024-01-30", "2024-01-29", "2024-01-28", "2024-01-27", "2024-01-26",
    "2024-01-22", "2024-01-21", "2024-01-20", "2024-01-19", "2024-01-18",
    "2024-01-17", "2024-01-16", "2024-01-15", "2024-01-14", "2024-01-13",
]
BEHAVIOURS = (1, 2, 3, 4)
SUB_WINDOWS = (5, 3, 7)
ENTITIES = {
    "user": ("u", ["user_id"]),
    "item": ("i", ["item_id"]),
    "category": ("c", ["item_category"]),
    "user_category": ("uc", ["user_id", "item_category"]),
    "user_item": ("ui", ["user_id", "item_id"]),
}
PROFILES = {"user": "uh", "user_item": "uih", "user_category": "uch"}

LOG = """
raw AS (
  SELECT e.user_id,
         CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS item_id,
         CAST(CASE e.event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2
              WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END AS INTEGER) AS behavior_type,
         CAST(split_part(p.p_brand, '#', 2) AS BIGINT) AS item_category,
         strftime(e.ts, '%Y-%m-%d %H') AS time
  FROM events e
  JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)
  WHERE e.event_type IN ('click', 'view', 'signup', 'purchase')),
log AS (
  SELECT user_id, item_id, behavior_type, item_category, time,
         CAST(split_part(time, ' ', 1) AS DATE) AS day,
         CAST(split_part(time, ' ', 2) AS INTEGER) AS hour
  FROM raw
  WHERE item_id IN (SELECT p_partkey FROM part WHERE p_size <= 40)
    AND split_part(time, ' ', 1) NOT IN ('2024-01-23', '2024-01-24'))"""

_WIDER = "CASE WHEN l - 5 IN (DATE '2024-01-23', DATE '2024-01-24') THEN 2 ELSE 0 END"


def _train_spine() -> str:
    days = ", ".join(f"(DATE '{d}')" for d in LABEL_DAYS)
    return f"""
spine AS (
  SELECT l AS label_day, l - 1 AS sample_day,
         CASE WHEN l >= DATE '2024-01-24' THEN l - 11 ELSE l - 9 END AS long_from,
         l - 1 AS long_to,
         l - (7 + {_WIDER}) AS d7_from, l - (5 + {_WIDER}) AS d5_from,
         l - (3 + {_WIDER}) AS d3_from
  FROM (VALUES {days}) AS t(l))"""


def _score_spine(day: str = "2024-01-30") -> str:
    return f"""
spine AS (
  SELECT l AS label_day, l AS sample_day, l - 8 AS long_from, l AS long_to,
         l - 7 AS d7_from, l - 5 AS d5_from, l - 3 AS d3_from
  FROM (VALUES (DATE '{day}')) AS t(l))"""


WINDOWED = """
windowed AS (
  SELECT s.*, g.* FROM log g JOIN spine s ON g.day BETWEEN s.long_from AND s.long_to)"""


def _query(body: str, *ctes: str) -> str:
    return "WITH " + ",".join((LOG, *ctes)) + "\n" + body


def _train(body: str, *ctes: str) -> str:
    return _query(body, _train_spine(), WINDOWED, *ctes)


def _inside(window: str) -> str:
    if window == "long":
        return "TRUE"
    return "day = sample_day" if window == "d1" else f"day >= {window}_from"


def _count_columns(prefix: str, window: str) -> list[str]:
    return [
        f"count(*) FILTER (WHERE behavior_type = {b} AND {_inside(window)}) AS {prefix}_{window}_b{b}"
        for b in BEHAVIOURS
    ]


def _ratio_columns(counts: str, out: str) -> list[str]:
    return [
        f"CASE WHEN {counts}_b4 = 0 THEN 0.0::DOUBLE ELSE {counts}_b{b}::DOUBLE / {counts}_b4::DOUBLE END"
        f" AS {out}_{name}"
        for name, b in (("click", 1), ("skim", 2), ("collect", 3))
    ]


def _average_columns(prefix: str) -> list[str]:
    return [f"{prefix}_long_b{b}::DOUBLE / 10.0::DOUBLE AS {prefix}_avg_b{b}" for b in BEHAVIOURS]


def _profile_columns(stem: str, inside: str = "day = sample_day") -> list[str]:
    return [
        f"count(*) FILTER (WHERE hour = {h} AND behavior_type = {b} AND {inside}) AS {stem}_h{h:02d}_b{b}"
        for h in range(24)
        for b in BEHAVIOURS
    ]


def _j(parts: list[str]) -> str:
    return ", ".join(parts)


def _counts(name: str, window: str) -> str:
    prefix, keys = ENTITIES[name]
    return (
        f"SELECT label_day, {_j(keys)}, {_j(_count_columns(prefix, window))} FROM windowed "
        f"WHERE {_inside(window)} GROUP BY label_day, {_j(keys)}"
    )


def _block(name: str) -> str:
    """The whole block of an entity, one row per label day and key in the long window."""
    prefix, keys = ENTITIES[name]
    rates = name in ("user", "item", "category")
    columns = _count_columns(prefix, "long") + _count_columns(prefix, "d1")
    for n in SUB_WINDOWS:
        columns += _count_columns(prefix, f"d{n}")
    if name == "item":
        columns += [
            f"count(DISTINCT CASE WHEN behavior_type = {b} THEN user_id END) AS i_uniq_b{b}"
            for b in BEHAVIOURS
        ]
    one_day = "FILTER (WHERE day = sample_day)"
    if not rates or name == "user":
        columns += [f"coalesce(min(hour) {one_day}, 0) AS {prefix}_hour_min",
                    f"coalesce(max(hour) {one_day}, 0) AS {prefix}_hour_max"]
    if name == "user":
        columns += [f"coalesce(max(hour) {one_day} - min(hour) {one_day}, 0) AS u_hour_range"]
        columns += [
            f"count(DISTINCT CASE WHEN behavior_type = {b} THEN day END) AS ulive_days_b{b}"
            for b in BEHAVIOURS
        ]
    if not rates:
        columns += [f"coalesce(max(behavior_type) {one_day}, 0) AS {prefix}_type_max"]
    if name in PROFILES:
        columns += _profile_columns(PROFILES[name])
    inner = (
        f"SELECT label_day, {_j(keys)}, {_j(columns)} FROM windowed GROUP BY label_day, {_j(keys)}"
    )
    if not rates:
        return inner
    extra = _average_columns(prefix) + _ratio_columns(f"{prefix}_long", f"{prefix}_ratio")
    return f"SELECT *, {_j(extra)} FROM ({inner})"


TRAIN_SAMPLES = """
samples AS (
  SELECT s.label_day, g.user_id, g.item_id, min(g.item_category) AS item_category,
         CAST(EXISTS (SELECT 1 FROM log b WHERE b.behavior_type = 4 AND b.day = s.label_day
                      AND b.user_id = g.user_id AND b.item_id = g.item_id) AS INTEGER) AS label
  FROM log g JOIN spine s ON g.day = s.sample_day
  WHERE g.user_id IS NOT NULL AND g.item_id IS NOT NULL
  GROUP BY s.label_day, g.user_id, g.item_id)"""
SCORE_SAMPLES = """
samples AS (
  SELECT s.label_day, g.user_id, g.item_id, min(g.item_category) AS item_category
  FROM log g JOIN spine s ON g.day = s.sample_day
  WHERE g.user_id IS NOT NULL AND g.item_id IS NOT NULL
  GROUP BY s.label_day, g.user_id, g.item_id)"""

SAMPLE_WITH_BLOCKS = """
FROM samples
LEFT JOIN b_user USING (label_day, user_id)
LEFT JOIN b_item USING (label_day, item_id)
LEFT JOIN b_category USING (label_day, item_category)
LEFT JOIN b_user_category USING (label_day, user_id, item_category)
LEFT JOIN b_user_item USING (label_day, user_id, item_id)"""


def _blocks() -> list[str]:
    return [f"\nb_{name} AS ({_block(name)})" for name in ENTITIES]


def _train_features(select: str) -> str:
    return _train(select + SAMPLE_WITH_BLOCKS, TRAIN_SAMPLES, *_blocks())


def _score_features(select: str, day: str = "2024-01-30") -> str:
    return _query(
        select + SAMPLE_WITH_BLOCKS, _score_spine(day), WINDOWED, SCORE_SAMPLES, *_blocks()
    )


def _weighted() -> str:
    """All features in one number that tells their order: each times its place."""
    return " + ".join(f"{at} * {c}::DOUBLE" for at, c in enumerate(feature_names(), 1))


def feature_names() -> list[str]:
    """Feature columns in their order, written out from the block list."""
    def four(stem: str) -> list[str]:
        return [f"{stem}_b{b}" for b in BEHAVIOURS]

    def ratio(stem: str) -> list[str]:
        return [f"{stem}_{r}" for r in ("click", "skim", "collect")]

    def profile(stem: str) -> list[str]:
        return [f"{stem}_h{h:02d}_b{b}" for h in range(24) for b in BEHAVIOURS]

    names: list[str] = []
    for p in ("u", "i", "c"):
        names += four(f"{p}_long") + four(f"{p}_d1") + four(f"{p}_avg") + ratio(f"{p}_ratio")
        names += four("i_uniq") if p == "i" else []
        names += four(f"{p}_d5") + four(f"{p}_d3") + four(f"{p}_d7")
        names += ["u_hour_min", "u_hour_max", "u_hour_range"] if p == "u" else []
    for p in ("uc", "ui"):
        names += four(f"{p}_long") + four(f"{p}_d1")
        names += [f"{p}_hour_min", f"{p}_hour_max", f"{p}_type_max"]
        names += four(f"{p}_d5") + four(f"{p}_d3") + four(f"{p}_d7")
    return names + profile("uh") + profile("uih") + profile("uch") + four("ulive_days")


SCORED = (
    "SELECT label_day, user_id, item_id, (10 * (ui_d1_b1 + 2 * ui_d1_b2 + 3 * ui_d1_b3"
    " + 4 * ui_d1_b4) + u_long_b4)::DOUBLE AS prob"
)


def _top(k: int, columns: str = "*") -> str:
    return (
        f"SELECT {columns} FROM ({_train_features(SCORED)}) "
        f"ORDER BY prob DESC, label_day, user_id, item_id LIMIT {k}"
    )


def _days_before(n: int, stem: str) -> str:
    """Hour profile per user over the n calendar days before the label day."""
    return _query(
        f"SELECT label_day, user_id, {_j(_profile_columns(stem, 'TRUE'))} "
        f"FROM log JOIN spine ON day >= label_day - {n} AND day < label_day "
        "GROUP BY label_day, user_id",
        _train_spine(),
    )


EVALUATE = """
SELECT CASE WHEN tp = 0 THEN NULL
       ELSE 2 * (tp::DOUBLE / predicted) * (tp::DOUBLE / actual)
            / ((tp::DOUBLE / predicted) + (tp::DOUBLE / actual)) END AS f_score,
       tp::DOUBLE / predicted AS precision, tp::DOUBLE / actual AS recall, tp, predicted, actual
FROM (SELECT (SELECT count(*) FROM guessed) AS predicted,
             (SELECT count(*) FROM bought) AS actual,
             (SELECT count(*) FROM guessed JOIN bought USING (user_id, item_id)) AS tp)"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {
        "prep_log": _query("SELECT * FROM log"),
        "label_spine": _train(
            "SELECT s.label_day, s.sample_day, s.long_from, s.long_to, s.d7_from, s.d5_from, s.d3_from, "
            "count(DISTINCT w.day) AS long_days, count(*) AS long_rows, "
            + _j([
                f"count(*) FILTER (WHERE {cond}) AS {name}_rows"
                for name, cond in (("d1", "w.day = s.sample_day"), ("d3", "w.day >= s.d3_from"),
                                   ("d5", "w.day >= s.d5_from"), ("d7", "w.day >= s.d7_from"))
            ])
            + " FROM spine s JOIN log w ON w.day BETWEEN s.long_from AND s.long_to"
            " GROUP BY ALL"
        ),
        "one_day_slice": _query(
            "SELECT log.*, label_day FROM log JOIN spine ON day = sample_day", _train_spine()
        ),
        "long_window_train": _query(
            "SELECT log.*, label_day FROM log JOIN spine ON day BETWEEN long_from AND long_to",
            _train_spine(),
        ),
        "long_window_score": _query(
            "SELECT log.*, label_day FROM log JOIN spine ON day BETWEEN long_from AND long_to",
            _score_spine(),
        ),
        "label_purchases": _query(
            "SELECT * FROM log WHERE behavior_type = 4 AND day IN (SELECT label_day FROM spine)",
            _train_spine(),
        ),
        "purchase_flag": _query(
            "SELECT log.*, label_day, CAST(behavior_type = 4 AS INTEGER) AS build_label "
            "FROM log JOIN spine ON day = sample_day",
            _train_spine(),
        ),
        "train_samples": _train(
            "SELECT label_day, user_id, item_id, item_category FROM samples", TRAIN_SAMPLES
        ),
        "train_labels": _train("SELECT * FROM samples", TRAIN_SAMPLES),
        "samples_subset": _train(
            "SELECT * FROM samples",
            TRAIN_SAMPLES.replace(
                "GROUP BY s.", "AND g.behavior_type IN (3, 2) GROUP BY s."
            ),
        ),
        "score_samples": _query("SELECT * FROM samples", _score_spine(), SCORE_SAMPLES),
        "samples_per_day": _train(
            "SELECT label_day, count(*) AS samples FROM samples GROUP BY label_day", TRAIN_SAMPLES
        ),
    }
    for name, (prefix, keys) in ENTITIES.items():
        for window in ("long", "d1", "d5", "d3", "d7"):
            sql[f"cnt_{name}_{window}"] = _train(_counts(name, window))
        sql[f"feat_{name}"] = _train(_block(name))
        ids = _j(["label_day", *keys])
        if name in ("user", "item", "category"):
            counted = f"FROM ({_counts(name, 'long')})"
            sql[f"avg_{name}"] = _train(f"SELECT {ids}, {_j(_average_columns(prefix))} {counted}")
            sql[f"ratio_{name}"] = _train(
                f"SELECT {ids}, {_j(_ratio_columns(f'{prefix}_long', f'{prefix}_ratio'))} {counted}"
            )
            for window in ("d5", "d3"):
                columns = _ratio_columns(f"{prefix}_{window}", f"{prefix}_{window}_ratio")
                sql[f"ratio_{window}_{name}"] = _train(
                    f"SELECT {ids}, {_j(columns)} FROM ({_counts(name, window)})"
                )
        if name in PROFILES:
            sql[f"hour_profile_{name}"] = _train(
                f"SELECT {ids}, {_j(_profile_columns(PROFILES[name]))} FROM windowed "
                f"WHERE day = sample_day GROUP BY {ids}"
            )
            spread = ", max(hour) - min(hour) AS u_hour_range" if name == "user" else ""
            sql[f"hours_{name}"] = _train(
                f"SELECT {ids}, min(hour) AS {prefix}_hour_min, max(hour) AS {prefix}_hour_max"
                f"{spread} FROM windowed WHERE day = sample_day GROUP BY {ids}"
            )
        if name in ("user_item", "user_category"):
            sql[f"type_max_{name}"] = _train(
                f"SELECT {ids}, max(behavior_type) AS {prefix}_type_max FROM windowed "
                f"WHERE day = sample_day GROUP BY {ids}"
            )
            sql[f"span_{name}"] = _train(
                f"SELECT {ids}, CAST(max(day) - min(day) AS INTEGER) AS {prefix}_span "
                f"FROM windowed GROUP BY {ids}"
            )
    sql |= {
        "uniq_users_item": _train(
            "SELECT label_day, item_id, "
            + _j([
                f"count(DISTINCT CASE WHEN behavior_type = {b} THEN user_id END) AS i_uniq_b{b}"
                for b in BEHAVIOURS
            ])
            + " FROM windowed GROUP BY label_day, item_id"
        ),
        "live_days_user": _train(
            "SELECT label_day, user_id, "
            + _j([
                f"count(DISTINCT CASE WHEN behavior_type = {b} THEN day END) AS ulive_days_b{b}"
                for b in BEHAVIOURS
            ])
            + " FROM windowed GROUP BY label_day, user_id"
        ),
        "hour_profile_user_2d": _days_before(2, "uh2d"),
        "hour_profile_user_5d": _days_before(5, "uh5d"),
        "train_features": _train_features(
            "SELECT label_day, user_id, item_id, item_category, label, " + _j(feature_names())
        ),
        "train_features_extras": _train_features_extras(),
        "score_features": _score_features(
            "SELECT label_day, user_id, item_id, item_category, " + _j(feature_names())
        ),
        "train_vectors": _train_features(
            f"SELECT label_day, user_id, item_id, label, {len(feature_names())}::INTEGER AS n_features, "
            "CAST(" + " + ".join(f"CAST({c} <> 0 AS INTEGER)" for c in feature_names())
            + " AS INTEGER) AS n_nonzero, round("
            + " + ".join(f"{c}::DOUBLE" for c in feature_names())
            + f", 6) AS total, round({_weighted()}, 5) AS weighted"
        ),
        "downsample": _train(
            """SELECT label_day, user_id, item_id, item_category, label
FROM (SELECT *, row_number() OVER (PARTITION BY label
             ORDER BY md5(concat_ws('|', CAST(label_day AS VARCHAR), user_id, item_id, 10))) AS nth
      FROM samples)
WHERE label = 1 OR nth <= 90 * (SELECT count(*) FROM samples WHERE label = 1)""",
            TRAIN_SAMPLES,
        ),
        "topk_700": _top(700),
        "topk_900": _top(900),
        "submission": _top(700, "user_id, item_id"),
        "evaluate": _query(
            EVALUATE,
            "\nguessed AS (SELECT DISTINCT user_id, item_id FROM log WHERE day = DATE '2024-01-21')",
            "\nbought AS (SELECT DISTINCT user_id, item_id FROM log"
            " WHERE day = DATE '2024-01-22' AND behavior_type = 4)",
        ),
        "evaluate_top": _evaluate(
            "SELECT * FROM scored ORDER BY prob DESC, user_id, item_id LIMIT 50"
        ),
        "evaluate_repeated": _evaluate(
            "SELECT user_id, item_id, max(prob) AS prob FROM ("
            "SELECT * FROM scored UNION ALL SELECT user_id, item_id, (user_id % 7 * 10)::DOUBLE FROM scored) "
            "GROUP BY user_id, item_id ORDER BY prob DESC, user_id, item_id LIMIT 50"
        ),
        "gbt_checks": _gbt_checks(),
        "io_roundtrip": _io_roundtrip(),
        "downsample_bernoulli": _bernoulli(),
        "quarantine": _quarantine(),
        "gbt_stored": _query(
            "SELECT count(*) AS n_scored, 0::BIGINT AS n_different FROM samples", _score_spine(), SCORE_SAMPLES
        ),
        "ranking_all": (
            "SELECT *, row_number() OVER (ORDER BY prob DESC, label_day, user_id, item_id) AS rank "
            f"FROM ({_train_features(SCORED)})"
        ),
        "evaluate_every_k": _evaluate_every_k(),
    }
    sql["uniq_users_item_sketch"] = f"""
SELECT label_day, x.b::INTEGER AS behaviour, count(*) FILTER (WHERE x.n > 0) AS n_items,
       sum(x.n)::BIGINT AS users, 0::BIGINT AS n_beyond
FROM (SELECT label_day, unnest([{_j([f"{{'b': {b}, 'n': i_uniq_b{b}}}" for b in BEHAVIOURS])}]) AS x
      FROM ({sql["uniq_users_item"]}))
GROUP BY ALL"""
    for name, same in {
        "train_features_incremental": "train_features",
        "train_features_placed": "train_features",
        "long_window_calendar": "long_window_train",
        "train_labels_calendar": "train_labels",
        "cnt_user_calendar": "cnt_user_long",
        "cnt_user_item_calendar": "cnt_user_item_long",
    }.items():
        sql[name] = sql[same]
    return sql


def _train_features_extras() -> str:
    """All features, and behind them the families that are not among the 426."""
    columns, ctes, joins = [], [], ""
    for p in ("u", "i", "c"):
        for n in (5, 3):
            columns += _ratio_columns(f"{p}_d{n}", f"{p}_d{n}_ratio")
    for name in ("user_item", "user_category"):
        prefix, keys = ENTITIES[name]
        ids = _j(["label_day", *keys])
        columns.append(f"{prefix}_span")
        ctes.append(
            f"\ns_{name} AS (SELECT {ids}, CAST(max(day) - min(day) AS INTEGER) AS {prefix}_span"
            f" FROM windowed GROUP BY {ids})"
        )
        joins += f"\nLEFT JOIN s_{name} USING ({ids})"
    for n in (2, 5):
        names = [f"uh{n}d_h{h:02d}_b{b}" for h in range(24) for b in BEHAVIOURS]
        columns += names
        ctes.append(
            f"\np_{n} AS (SELECT label_day, user_id, {_j(_profile_columns(f'uh{n}d', 'TRUE'))} FROM log"
            f" JOIN spine ON day >= label_day - {n} AND day < label_day GROUP BY label_day, user_id)"
        )
        joins += f"\nLEFT JOIN p_{n} USING (label_day, user_id)"
    select = "SELECT label_day, user_id, item_id, item_category, label, " + _j(feature_names() + columns)
    return _train(select + SAMPLE_WITH_BLOCKS + joins, TRAIN_SAMPLES, *_blocks(), *ctes)


def _evaluate(best: str) -> str:
    """Metrics of the best of the pairs scored on 21 January."""
    scored = _score_features(SCORED, "2024-01-21")
    return _query(
        EVALUATE,
        f"\nscored AS (SELECT user_id, item_id, prob FROM ({scored}))",
        f"\nguessed AS ({best})",
        "\nbought AS (SELECT DISTINCT user_id, item_id FROM log"
        " WHERE day = DATE '2024-01-22' AND behavior_type = 4)",
    )


def _gbt_checks() -> str:
    """What holds for a ranking whatever the model's numbers are."""
    train = _train("SELECT label FROM samples", TRAIN_SAMPLES)
    score = _query("SELECT * FROM samples", _score_spine(), SCORE_SAMPLES)
    return f"""
SELECT s.n AS n_scored, s.n AS n_pairs, 0::BIGINT AS n_other_days, 0::BIGINT AS n_not_probabilities,
       least(s.n, 700) AS n_ranked, 0::BIGINT AS n_rising, t.positives AS n_positives,
       t.positives + least(t.negatives, 90 * t.positives) AS n_training
FROM (SELECT count(*) AS n FROM ({score})) s,
     (SELECT count(*) FILTER (WHERE label = 1) AS positives,
             count(*) FILTER (WHERE label = 0) AS negatives FROM ({train})) t"""


def _bernoulli() -> str:
    """Each negative whose hash, as a number from 0 to 1, is below the share wanted."""
    return _train(
        """,
sized AS (SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives
          FROM samples),
tossed AS (SELECT samples.*, label = 1 OR
  ('0x' || substr(md5(concat_ws('|', CAST(label_day AS VARCHAR), user_id, item_id, 10)), 1, 13))::BIGINT::DOUBLE
    / 4503599627370496::DOUBLE < least(1.0::DOUBLE, (90 * positives)::DOUBLE / negatives::DOUBLE) AS keep
  FROM samples, sized)
SELECT label_day, user_id, item_id, item_category, label, n::DOUBLE / drawn::DOUBLE AS weight
FROM tossed JOIN (SELECT label, count(*) AS n, count(*) FILTER (WHERE keep) AS drawn FROM tossed GROUP BY label)
  USING (label) WHERE keep""",
        TRAIN_SAMPLES,
    ).replace("\n,\nsized", ",\nsized")


def _quarantine() -> str:
    return f"""
WITH {LOG}
SELECT CASE (user_id + item_id) % 40 WHEN 1 THEN 'unparsable' WHEN 2 THEN 'bad_time' WHEN 3 THEN 'bad_time'
       WHEN 4 THEN 'bad_time' ELSE 'taken' END AS reason, count(*) AS n_rows
FROM raw GROUP BY 1"""


def _evaluate_every_k() -> str:
    """Metrics of the best K of the pairs scored on 21 January, for every K."""
    scored = _score_features(SCORED, "2024-01-21")
    return _query(
        """
SELECT user_id, item_id, prob, k, tp, actual, precision, recall,
       CASE WHEN tp > 0 THEN 2 * precision * recall / (precision + recall) END AS f_score
FROM (SELECT *, tp::DOUBLE / k AS precision, tp::DOUBLE / actual AS recall
      FROM (SELECT user_id, item_id, prob, (SELECT count(*) FROM bought) AS actual,
                   row_number() OVER best AS k,
                   (sum(CASE WHEN b.u IS NULL THEN 0 ELSE 1 END) OVER best)::BIGINT AS tp
            FROM scored LEFT JOIN (SELECT user_id AS u, item_id AS i FROM bought) b ON u = user_id AND i = item_id
            WINDOW best AS (ORDER BY prob DESC, user_id, item_id ROWS UNBOUNDED PRECEDING)))""",
        f"\nscored AS (SELECT user_id, item_id, prob FROM ({scored}))",
        "\nbought AS (SELECT DISTINCT user_id, item_id FROM log"
        " WHERE day = DATE '2024-01-22' AND behavior_type = 4)",
    )


def _io_roundtrip() -> str:
    def totals(name: str, day: str, source: str) -> str:
        return (
            f"SELECT '{name}' AS sink, {day} AS day, count(*) AS n_rows, "
            "CAST(sum(user_id) AS BIGINT) AS user_total, CAST(sum(item_id) AS BIGINT) AS item_total, "
            f"round(sum(value), 2) AS value_total FROM ({source}) GROUP BY {day}"
        )

    # Every column of a table takes part, with its own factor.
    weighted = f"SELECT label_day, user_id, item_id, item_category::DOUBLE + {_weighted()} AS value"
    train = weighted.replace(" AS value", f" + {len(feature_names()) + 1} * label::DOUBLE AS value")
    log = _query(
        "SELECT day, user_id, item_id, (hour + 100 * behavior_type + 1000 * item_category)::DOUBLE AS value FROM log"
    )
    return " UNION ALL ".join([
        totals("prepared", "day", log),
        totals("prepared_csv", "day", log),
        totals("train", "label_day", _train_features(train)),
        totals("score", "label_day", _score_features(weighted)),
        totals("train_csv", "label_day", _train_features(train)),
    ])

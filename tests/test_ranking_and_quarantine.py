"""The whole ranking, metrics at every K, and lines that cannot be read."""

from __future__ import annotations

import json
import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dayrank.operators.evaluate import evaluate, evaluate_every_k
from dayrank.operators.quarantine import accepted, counts, quarantined
from dayrank.operators.ranking import top_k, whole_ranking
from dayrank.plans import jobs
from dayrank.session import materialize
from dayrank.sources import behaviour as io
from dayrank.sources.warehouse import EVENTS_CONFIG as CFG


@pytest.fixture
def many_ranges(spark):
    """So many shuffle partitions, none joined, that a sort is cut into many ranges."""
    settings = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.fixture
def scored(spark):
    """Scores with many ties: most pairs have the same."""
    rng = random.Random(41)
    rows = [(u, i, rng.choice([0.5, 0.5, 0.5, 0.25, 0.75, rng.random()])) for u in range(60) for i in range(25)]
    return materialize(spark.createDataFrame(rows, "user_id long, item_id long, prob double").repartition(5), "scored")


def test_ranks_equal_a_sort(scored, many_ranges):
    wanted = sorted(map(tuple, scored.collect()), key=lambda r: (-r[2], r[0], r[1]))
    found = whole_ranking(scored)
    assert [tuple(r)[:3] for r in sorted(found.collect(), key=lambda r: r.rank)] == wanted
    assert sorted(r["rank"] for r in found.select("rank").collect()) == list(range(1, len(wanted) + 1))
    best = [tuple(r) for r in top_k(scored, 100).collect()]
    assert best == [tuple(r)[:3] for r in found.filter("rank <= 100").orderBy("rank").collect()]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0]


def test_no_scores(spark, scored, many_ranges):
    assert whole_ranking(scored.filter("false")).collect() == []
    none = spark.createDataFrame([], "user_id long, item_id long")
    assert evaluate_every_k(scored.filter("false"), none).collect() == []
    found = evaluate_every_k(scored, none).collect()
    assert len(found) == 1500 and all(r.tp == 0 and r.actual == 0 and r.recall is None for r in found)


def test_metrics_at_every_k_equal_those_of_the_best_k(spark, scored, many_ranges):
    rng = random.Random(42)
    pairs = {(rng.randrange(70), rng.randrange(30)) for _ in range(300)}
    actual = materialize(spark.createDataFrame(sorted(pairs), "user_id long, item_id long"), "actual")
    repeated = scored.unionByName(scored.withColumn("prob", F.col("prob") / 2))
    repeated = repeated.unionByName(scored.limit(3).withColumn("prob", F.lit(None).cast("double")))
    found = {r.k: r for r in evaluate_every_k(repeated, actual).collect()}
    assert sorted(found) == list(range(1, 1501))
    order = sorted(map(tuple, scored.collect()), key=lambda r: (-r[2], r[0], r[1]))
    hits = 0
    for k, (user, item, _) in enumerate(order, 1):
        hits += (user, item) in pairs
        r = found[k]
        assert (r.user_id, r.item_id, r.tp, r.actual) == (user, item, hits, len(pairs))
        assert r.precision == hits / k and r.recall == hits / len(pairs)
    for k in (1, 77, 1500):
        one = evaluate(top_k(scored, k), actual).first()
        assert (one.tp, one.precision, one.recall, one.f_score) == (
            found[k].tp, found[k].precision, found[k].recall, found[k].f_score
        )


GOOD = ["1,2,1,3,2024-01-05 07", "1,2,4,3,2024-01-06 23", ",2,1,3,2024-01-05 00", "1,2,9,3,2024-01-07 5", "1,2,,,2024-01-07 05"]
BAD = {
    "unparsable": [
        "x1,2,1,3,2024-01-05 07", "1,2.5,1,3,2024-01-05 07", "1,2,one,3,2024-01-05 07", "1,2,1", "1,2,1,3,2024-01-05 07,9",
        "99999999999999999999999,2,1,3,2024-01-05 07", "garbage", "中文,é,,",
    ],
    "bad_time": [
        "1,2,1,3,yesterday", "1,2,1,3,", "1,2,1,3,2024-01-05", "1,2,1,3,2024-13-05 07", "1,2,1,3,2024-02-30 07",
        "1,2,1,3,2024-01-05 24", "1,2,1,3,2024-01-05 -1", "1,2,1,3,2024-01-05T07", "1,2,1,3,2024-01-05 7x",
    ],
}


@pytest.fixture
def lines(tmp_path):
    rng = random.Random(43)
    every = GOOD + [x for found in BAD.values() for x in found]
    folder = tmp_path / "log"
    folder.mkdir()
    for name in ("a", "b"):
        rng.shuffle(every)
        text = "\n".join(["user_id,item_id,behavior_type,item_category,time", *every]) + "\n"
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


def test_bad_lines_are_set_aside_and_counted(spark, lines):
    rows = io.read_raw_log_checked(spark, lines)
    assert accepted(rows).count() == 2 * len(GOOD)
    found = {r.reason: r.n_rows for r in counts(quarantined(rows)).collect()}
    assert found == {reason: 2 * len(found) for reason, found in BAD.items()}
    kept = sorted(r.line for r in quarantined(rows).filter("reason = 'unparsable'").collect())
    assert kept == sorted(2 * BAD["unparsable"])
    # Nothing vanishes, whatever columns a plan needs.
    assert accepted(rows).select("time").count() + quarantined(rows).select("reason").count() == rows.count()


def test_prepare_job_ends_and_tells(spark, lines, tmp_path):
    items = tmp_path / "items"
    items.mkdir()
    (items / "i.csv").write_text("item_id\n2\nnone\n7\n")
    out = str(tmp_path / "prepared")
    jobs.prepare_job(spark, lines, str(items), out, CFG)
    prepared = io.read_prepared(spark, out)
    assert prepared.count() == 2 * len(GOOD)
    assert {r.day for r in prepared.select("day").collect()} == {date(2024, 1, d) for d in (5, 6, 7)}
    told = [json.loads(x) for f in Path(f"{out}-quarantine-counts").glob("*.json") for x in f.read_text().splitlines()]
    assert {(r["source"], r["reason"]): r["n_rows"] for r in told} == {
        ("log", "unparsable"): 16, ("log", "bad_time"): 18, ("items", "unparsable"): 1
    }


def test_a_clean_log_has_an_empty_quarantine(spark, tmp_path):
    (tmp_path / "log.csv").write_text("user_id,item_id,behavior_type,item_category,time\n" + "\n".join(GOOD) + "\n")
    (tmp_path / "items.csv").write_text("item_id\n2\n")
    out = str(tmp_path / "prepared")
    jobs.prepare_job(spark, str(tmp_path / "log.csv"), str(tmp_path / "items.csv"), out, CFG)
    assert io.read_prepared(spark, out).count() == len(GOOD)
    lines = spark.read.schema("line string, source string, reason string").parquet(f"{out}-quarantine")
    assert lines.count() == 0


def test_a_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "log.csv").write_text("item_id,user_id,behavior_type,item_category,time\n1,2,1,3,2024-01-05 07\n")
    with pytest.raises(Exception, match="(?i)header"):
        io.read_raw_log_checked(spark, str(tmp_path / "log.csv")).collect()

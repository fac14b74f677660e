from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayrank.llm import toxicity
from dayrank.llm.catalog import QUERIES
from dayrank.llm.toxicity import Pieces
from tests.llm.helpers import documents, sorted_rows


def corpus(n=900, seed=2):
    """Ordinary texts, and toxic ones that hold a word or two of a list."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    bad = ["zquark", "blavvg", "xorkwim"]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 400))]
        toxic = int(r.random() < 0.3)
        for _ in range(r.randint(1, 3) * toxic):
            text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((i, " ".join(text).capitalize()))
        labels.append((i, toxic))
    return rows, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = documents(spark, rows).drop("score")
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.fit(docs, frame).score(docs).collect()}
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores.values())
    mine = [(scores[i] >= 0.5) == bool(t) for i, t in labels if held_out(i)]
    assert len(mine) > 100 and sum(mine) / len(mine) >= 0.97


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows, labels = corpus(300)
    docs = documents(spark, rows)
    turned = [(i, 1 - t if held_out(i) else t) for i, t in labels]
    both = [
        sorted_rows(toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")).score(docs), "doc_id", "score")
        for x in (labels, turned)
    ]
    assert both[0] == both[1]


def test_odd_rows(spark):
    rows, labels = corpus(300)
    odd = [(None, "zquark"), (1000, None), (1001, ""), (1002, "zquark " * 200_000), (1003, "zquark"), (1003, "zquark")]
    docs = documents(spark, rows + odd)
    frame = spark.createDataFrame(
        [*labels, (None, 1), (1001, 7), (3, None), (4, 0), (4, 1), (9999, 1)], "doc_id long, toxic int"
    ).withColumn("text", F.lit("x"))
    out = toxicity.fit(docs, frame).score(docs).collect()
    assert len(out) == len(rows) + len(odd)
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert by_id[1000] == by_id[1001] and by_id[1003][0] == by_id[1003][1] == by_id[None][0]
    assert by_id[1002][0] > 0.9


@pytest.mark.parametrize(("toxic", "score"), [([], 0.0), ([0] * 50, 0.0), ([1] * 50, 1.0)])
def test_nothing_to_learn_from(spark, toxic, score):
    docs = documents(spark, [(i, f"some words {i}") for i in range(50)])
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    assert {r.score for r in toxicity.fit(docs, labels).score(docs).collect()} == {score}
    empty = documents(spark, [])
    assert toxicity.fit(empty, labels).score(empty).count() == 0


def test_pieces_of_a_long_text_add_up(monkeypatch):
    """A text cut into pieces has the features of the whole."""
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 3, 15, 16, 17, 500, 40)]

    class Fixed(toxicity.Likelihoods):
        def __init__(self):
            pass

        def log_ratio(self, codes):
            return np.sin(codes.astype(np.float64) % 1000)

    whole = Fixed().features(texts)
    monkeypatch.setattr(toxicity, "CHUNK", 20)
    for a, b in zip(whole, Fixed().features(texts), strict=True):
        assert np.allclose(a, b)
    codes = np.concatenate([p.grams()[0][p.grams()[2]] for p in Pieces.of([b"abcdefghij" * 5])])
    assert len(codes) == 50


def test_counts_are_exact(spark):
    """Each 5-gram and each of its parts has the counts of its own, however many there are."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000)) for _ in range(300)]
    rows = [(t, i % 3 == 0) for i, t in enumerate(texts)]
    grams = toxicity.count_grams(spark.createDataFrame(rows, "text string, toxic boolean"), "text")
    wanted = {"gram": {}, "context": {}, "short": {}, "short_context": {}}
    for text, toxic in rows:
        padded = b"\n" * 4 + text.encode()
        for g in {padded[k : k + 5] for k in range(len(text))}:
            wanted["gram"].setdefault(g, [0, 0])[toxic] += 1
    for g, n in wanted["gram"].items():
        of = wanted["context"].setdefault(g[:4], [0, 0, 0, 0])
        for c in (0, 1):
            of[c] += n[c]
            of[2 + c] += n[c] > 0
        wanted["short"].setdefault(g[1:], [0])[0] += 1
    for g, (n,) in wanted["short"].items():
        of = wanted["short_context"].setdefault(g[:3], [0, 0])
        of[0] += n
        of[1] += 1
    known = toxicity.Tables.of(grams).likelihoods.value
    for kind, each in wanted.items():
        codes = sorted((int.from_bytes(g, "big"), n) for g, n in each.items())
        assert known.codes[kind].tolist() == [c for c, _ in codes]
        assert known.counts[kind].tolist() == [n for _, n in codes]


@pytest.mark.parametrize("held", [toxicity.HELD_OUT, None])
def test_every_labelled_row_counts(spark, held):
    """An expression that only one labelled row holds is known, whichever fold that row is of."""
    rows, labels = corpus(100)
    marks = [f"{i:03d}#" for i in range(100)]
    docs = documents(spark, [(i, f"{t} {marks[i]}") for i, t in rows])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), held_out=held)
    codes = [int.from_bytes(b" " + m.encode(), "big") for m in marks]
    known = set(model.tables.likelihoods.value.codes["gram"].tolist())
    assert [c in known for c in codes] == [held is None or not held_out(i) for i in range(100)]


def test_joined_counts_score_alike(spark, monkeypatch):
    rows, labels = corpus(300)
    odd = [(None, "zquark"), (1000, None), (1001, ""), (1002, "zquark " * 20_000), (1003, "qqqqq"), (1003, "qqqqq")]
    docs = documents(spark, rows + odd)
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    columns = ("doc_id", "score", "mean", "peak", "lang", "text")
    sent = sorted_rows(toxicity.fit(docs, frame).score(docs, "doc_id", "text", "lang", "text"), *columns)
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    model = toxicity.fit(docs, frame)
    assert model.tables.likelihoods is None
    joined = sorted_rows(model.score(docs, "doc_id", "text", "lang", "text"), *columns)
    assert len(sent) == len(joined)
    for a, b in zip(sent, joined, strict=True):
        assert a[0] == b[0] and a[4:] == b[4:] and np.allclose(a[1:4], b[1:4])


def test_query(spark):
    rows = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in rows)

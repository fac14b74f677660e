"""Spelling variants against comparing every word with every other."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from dayrank.llm import spelling
from tests.llm.helpers import documents

LOWERED = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows) -> Counter:
    words: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    return Counter({w: n for w, n in words.items() if len(w) >= 5 and n >= 3})


def is_near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows) -> list[tuple]:
    words = counted(rows)
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and is_near(v, w)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v)) if found else None
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, rows) -> list[tuple]:
    frame = spelling.variants(documents(spark, rows))
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_variants_equal_brute_force(spark):
    rng = random.Random(11)
    rows: list[tuple] = []
    words = ["".join(rng.choice("abé") for _ in range(rng.choice((5, 6, 7)))) for _ in range(120)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "ÀBCDE", "àbcde", "Straße", "STRASSE", "×÷×÷×", "letter", "leter", "lettter"]
    for i in range(120):
        rows.append((i, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words)
                                 for _ in range(60))))
    rows += [(7, None), (8, ""), (9, "one two"), (None, "letter letter letter leter"), (None, "letter, leter; lettter")]
    rows += [(i, "hotword " * 300) for i in range(200, 260)]
    assert found(spark, rows) == plain(rows)


def test_chains_of_forms_end_at_their_root(spark):
    often = {"abcde": 3, "abcdx": 6, "abcyx": 12, "abzyx": 30, "awzyx": 100}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(often.items())]
    rows += [(50, "fghij " * 4 + "fghik " * 8 + "fghil " * 8)]  # a tie between forms
    assert found(spark, rows) == plain(rows)


def test_very_long_words_and_no_words(spark):
    long = "ab" * 15_000
    rows = [(i, f"{long} {long[:-1]} {long}x") for i in range(3)]
    got = found(spark, rows)
    assert [(r[0] == long, r[4]) for r in got if r[0] == long] == [(True, 2)]
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "a b c"), (3, "word1 word2")]) == []


def test_nodes_are_numbered_across_partitions(spark):
    """Equal prefixes have equal numbers and different ones different numbers, whatever the partitions."""
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(900)} | {"a" * 40})
    frame = spark.createDataFrame([(w,) for w in words], "word string").repartition(7)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        rows = spelling.numbered(frame, "word", "prefixes").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.word for r in sorted(rows, key=lambda r: r.place)] == words
    assert len({r.place // spelling.PART for r in rows}) > 20
    number: dict[str, int] = {}
    for r in rows:
        assert len(r.nodes) == len(r.word) + 1
        for depth, node in enumerate(r.nodes):
            assert number.setdefault(r.word[:depth], node) == node
    assert len(set(number.values())) == len(number)


def test_groups_of_the_dictionary_are_small(spark):
    rows = [(i, " ".join(f"{a}bcdefgh abcdefg{a} hot{a}word" for a in spelling.LOWER)) for i in range(4)]
    counted_words = spelling.word_counts(documents(spark, rows), None)
    forward = spelling.numbered(counted_words, "word", "prefixes").withColumnRenamed("nodes", "before")
    back = spelling.numbered(forward.selectExpr("place AS at", "reverse(word) AS back"), "back", "suffixes")
    pairs = spelling.dictionary(forward.join(back.selectExpr("at AS place", "nodes AS after"), "place"))
    sizes = pairs.groupBy("before", "after").count()
    assert sizes.agg({"count": "max"}).first()[0] <= len(spelling.LOWER) + 1
    assert spelling.near(forward.join(back.selectExpr("at AS place", "nodes AS after"), "place")).count() == 26 * 3 - 1

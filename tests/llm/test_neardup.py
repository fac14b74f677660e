from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dayrank.llm import neardup
from dayrank.llm.components import components
from tests.conftest import SF
from tests.llm.helpers import documents, sorted_rows

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def brute(rows, width, above, below):
    """{id: (set size, smallest id reachable)} by comparing all pairs that share a shingle."""
    sets: dict[int, list[frozenset]] = {}
    for i, text in rows:
        w = (text or "").encode().translate(LOWER).split()
        runs = [tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
        sets.setdefault(i, []).append(frozenset(runs))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    every = [(i, s) for i, group in sets.items() for s in group if s]
    lists: dict[tuple, list[int]] = {}
    for at, (_, s) in enumerate(every):
        for g in s:
            lists.setdefault(g, []).append(at)
    for a, (i, s) in enumerate(every):
        shared: dict[int, int] = {}
        for g in s:
            for b in lists[g]:
                if b < a:
                    shared[b] = shared.get(b, 0) + 1
        for b, k in shared.items():
            j, t = every[b]
            if below * k >= above * (len(s) + len(t) - k):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(
        (i, len(s), i if not s else find(i)) for i, group in sets.items() for s in group
    )


def found(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect())


@pytest.mark.parametrize(("width", "similarity"), [(5, (80, 100)), (2, (60, 100))])
def test_whole_table_against_brute_force(spark, width, similarity):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = found(neardup.near_duplicates(docs, width=width, similarity=similarity))
    assert got == brute(rows, width, *similarity)


def copies(seed: int) -> list[tuple[int, str]]:
    """Exact copies, near copies in a chain and a star, and a passage that many texts share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    texts = []
    base = [word() for _ in range(120)]
    texts += [" ".join(base)] * 40
    for _ in range(60):
        other = list(base)
        for _ in range(r.randint(1, 8)):
            other[r.randrange(len(other))] = word()
        texts.append(" ".join(other))
    walk = list(base)
    for _ in range(40):
        walk[r.randrange(len(walk))] = word()
        texts.append(" ".join(walk))
    passage = [word() for _ in range(30)]
    texts += [" ".join([*passage, *(word() for _ in range(r.randint(1, 30)))]) for _ in range(80)]
    r.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("cell", [7, 60, 1000])
@pytest.mark.parametrize("k", [16, 64])
def test_groups_of_copies_and_hot_passages(spark, cell, k):
    """Lists far longer than a cell; sketches that hold whole sets, and ones that do not."""
    rows = copies(k)
    got = found(
        neardup.near_duplicates(documents(spark, rows), width=3, similarity=(85, 100), k=k, cell=cell)
    )
    assert got == brute(rows, 3, 85, 100)


def test_odd_cases(spark):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [
        (5, text), (3, text.upper()), (9, None), (8, ""), (7, " \n\t"), (6, "two words"), (4, "Two  WORDS"), (2, "two"),
        (1, "word " * 300_000), (10, "word " * 250_000), (11, "a b c d e f g h"), (11, "p q r s t u v w"),
        (12, "a b c d e f g h"), (13, "p q r s t u v w"),
    ]
    got = found(neardup.near_duplicates(documents(spark, rows), width=3, similarity=(85, 100)))
    assert got == brute(rows, 3, 85, 100)
    nulls = neardup.near_duplicates(documents(spark, [(None, text), (1, text)]))
    assert sorted_rows(nulls, "doc_id", "component_id", "kept") == [(1, 1, True), (None, None, True)]
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    assert neardup.near_duplicates(documents(spark, [(1, None)])).collect()[0].kept


def test_links_within_a_cell_connect_what_all_links_connect():
    r = np.random.default_rng(1)
    for _ in range(60):
        base = r.choice(10_000, 60, replace=False)
        sets = []
        for _ in range(r.integers(2, 40)):
            s = base.copy()
            at = r.choice(60, r.integers(0, 12), replace=False)
            s[at] = r.integers(10_000, 10_400, len(at))
            sets.append(np.unique(s))

        def roots(pairs, n):
            root = list(range(n))
            for a, b in pairs:
                x, y = root[a], root[b]
                root = [min(x, y) if q in (x, y) else q for q in root]
            return root

        n = len(sets)
        every = [
            (i, j)
            for i in range(n)
            for j in range(i)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
        ]
        made = neardup.links_within(sets, (80, 100))
        assert set(made) <= set(every) | {(b, a) for a, b in every}
        assert len(made) < n
        assert roots(made, n) == roots(every, n)


def test_a_large_group_of_near_copies_makes_few_rows(spark):
    """Each copy meets its hubs and is then connected: cells get none of them."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(3000):
        other = list(base)
        other[r.randrange(150)] = f"x{i}"
        texts.append((i, " ".join(other)))
    docs = documents(spark, texts, extra=False)
    rows = neardup.sketches(docs, "doc_id", "text", 3, 64)
    classes = rows.selectExpr("set_id", "id AS rep", "1 AS n", "n_shingles", "sketch")
    found = neardup.prefixes(classes, 64, 0.8).cache()
    known = neardup.lists(neardup.in_lists(found), 100).cache()
    assert known.filter("large").count() > 10
    members = neardup.in_lists(found)
    sets = neardup.full_sets(docs, "doc_id", "text", 3)
    made = neardup.hub_links(members, known.filter("large"), sets, (80, 100), 100).collect()
    assert 2900 <= len(made) <= 4000  # hubs are linked anew in each part
    labelled = found.withColumn("label", F.lit(0).cast("long"))
    sizes = neardup.cells(labelled, known, 100).groupBy("cell").count().collect()
    assert sum(x["count"] for x in sizes) < 3000 and max((x["count"] for x in sizes), default=0) <= 200
    # Without labels, everything meets everything.
    apart = found.withColumn("label", F.col("rep"))
    sizes = neardup.cells(apart, known, 100).groupBy("cell").count().collect()
    assert max(x["count"] for x in sizes) <= 320
    got = neardup.near_duplicates(docs, width=3, similarity=(80, 100), cell=100).collect()
    assert {x.component_id for x in got} == {0}


def test_members_of_many_large_lists_meet_once(spark):
    """Copies with many changes are in many large lists together. Two that are not connected meet where
    they are first together, and cells hold few other pairs."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(400):
        other = list(base)
        for at in r.sample(range(150), r.randrange(12)):
            other[at] = f"x{r.randrange(300)}"
        texts.append((i, " ".join(other)))
    rows = neardup.sketches(documents(spark, texts, extra=False), "doc_id", "text", 3, 64)
    classes = rows.groupBy("set_id").agg(
        F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    found = neardup.prefixes(classes, 64, 0.85).cache()
    known = neardup.lists(neardup.in_lists(found), 40).cache()
    large = {x.value for x in known.collect() if x.large}
    assert len(large) > 20
    label = F.when(F.col("rep") % 3 == 0, F.lit(0)).otherwise(F.col("rep")).cast("long")
    labelled = found.withColumn("label", label).cache()
    lists = {x.rep: (x.label, set(x.prefix)) for x in labelled.collect()}
    wanted = {
        (a, b) for a, (la, x) in lists.items() for b, (lb, y) in lists.items() if a < b and la != lb and x & y
    }
    meeting, compared, held = set(), 0, {}
    for x in neardup.cells(labelled, known, 40).collect():
        held.setdefault(x.cell, []).append((x.rep, x.label, x["asked"], set(x.earlier)))
    for members in held.values():
        assert len(members) <= 160 and len({m[0] for m in members}) == len(members)
        compared += len(members) ** 2
        for a, la, asked, x in members:
            meeting |= {(a, b) for b, lb, too, y in members if a < b and la != lb and (asked or too) and not x & y}
    assert meeting == wanted
    assert compared < 12 * len(wanted)


def test_common_values_are_counted_alike(monkeypatch):
    r = np.random.default_rng(6)
    base = r.choice(10_000, 60, replace=False)
    sets = []
    for _ in range(90):
        s = base.copy()
        at = r.choice(60, r.integers(0, 14), replace=False)
        s[at] = r.integers(10_000, 10_400, len(at))
        sets.append(np.unique(s))
    made = neardup.links_within(sets, (80, 100))
    monkeypatch.setattr(neardup, "TILE", 7)
    assert neardup.links_within(sets, (80, 100)) == made
    asked = r.random(len(sets)) < 0.4
    some = neardup.links_within(sets, (80, 100), None, asked)
    assert 0 < len(some) <= len(made) and all(asked[a] for a, _ in some)


def test_tiles_and_labels_rule_out_the_same(monkeypatch):
    r = np.random.default_rng(2)
    pool = np.sort(r.choice(1 << 40, 400, replace=False))
    sets = [np.unique(r.choice(pool, r.integers(3, 90))) for _ in range(70)] + [pool[:80], pool[:82], pool[2:82]]
    sketches, sizes = [s[:64] for s in sets], np.array([len(s) for s in sets])
    none = [np.empty(0, dtype=np.int64)] * len(sets)
    whole = neardup.possible(sketches, sizes, none, 64, 0.8)
    assert whole[-3:].all() and not whole.all()
    monkeypatch.setattr(neardup, "TILE", 9)
    assert (neardup.possible(sketches, sizes, none, 64, 0.8) == whole).all()
    labels = np.arange(len(sets))
    labels[-3:] = 1000
    assert not neardup.possible(sketches, sizes, none, 64, 0.8, labels)[-3:].any()
    monkeypatch.setattr(neardup, "POSTINGS", 50)
    assert set(neardup.links_within(sets, (80, 100), labels)) == set()


def test_components_of_stars_chains_and_repeats(spark):
    star = [(i, 500) for i in range(501, 700)]
    chain = [(i, i + 1) for i in range(1000, 1200)]
    odd = [(3, 3), (4, 5), (5, 4), (4, 5), (None, 7), (7, None)]
    got = components(spark.createDataFrame(star + chain + odd, "a long, b long"))
    wanted = [(i, 500) for i in range(500, 700)] + [(i, 1000) for i in range(1000, 1201)] + [(4, 4), (5, 4)]
    assert sorted(map(tuple, got.select("node", "component").collect())) == sorted(wanted)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

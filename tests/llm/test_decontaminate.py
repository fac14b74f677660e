from __future__ import annotations

import pickle
import random
import re
import time

import pyarrow.parquet as pq

from dayrank.llm import decontaminate
from dayrank.llm.decontaminate import Automaton, clean, scan, words
from tests.conftest import SF
from tests.llm.helpers import documents

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, text, window):
    """(number of words, hit places, items) by comparing all windows."""
    document, windows = plain_words(text), {}
    for name, body in items:
        item = plain_words(body)
        for k in range(max(1, len(item) - window + 1) if item else 0):
            windows.setdefault(tuple(item[k : k + window]), set()).add(name)
    hit, found = set(), set()
    for n in {len(w) for w in windows}:
        for at in range(len(document) - n + 1):
            names = windows.get(tuple(document[at : at + n]))
            if names:
                hit |= set(range(at, at + n))
                found |= names
    return len(document), hit, found


def test_automaton_on_random_words():
    r = random.Random(3)
    for n in range(1500):
        letters = "abcd" if n % 2 else "ab"
        items = [(str(k), " ".join(r.choice(letters) for _ in range(r.randint(0, 9)))) for k in range(r.randint(0, 5))]
        text = " ".join(r.choice(letters + "x") for _ in range(r.randint(0, 30)))
        spans, names = Automaton([(i, words(x.encode())) for i, x in items], 4).hits(words(text.encode()))
        _, hit, found = brute(items, text, 4)
        assert {p for a, b in spans for p in range(a, b)} == hit and names == found


def frames(spark, rows, items):
    return documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")


def test_odd_cases_and_blocks(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, None), (2, ""), (3, " .,!"), (4, f"x {passage.upper()}; y"), (4, passage), (5, "short item"),
        (6, "two three four five six seven eight nine ten"), (None, passage), (7, "Ünï çode " * 50),
        (8, "filler " * 200_000 + passage),
    ]
    items = [(10, passage), (11, "Short, ITEM"), (12, None), (13, ""), (None, "ünï çode ünï"), (11, "other words here")]
    docs, benchmark = frames(spark, rows, items)
    for size in (10**6, 40):  # one block, several
        found = scan(docs, benchmark, block_words=size).collect()
        assert len(found) == len(rows)
        named = [(str(i) if i is not None else None, t) for i, t in items]
        got = sorted((r.doc_id or 0, r.n_words, sum(s.end - s.begin for s in r.spans), tuple(r["items"])) for r in found)
        wanted = []
        for i, t in rows:
            n, hit, names = brute(named, t, 10)
            wanted.append((i or 0, n, len(hit), tuple(sorted(x for x in names if x))))
        assert got == sorted(wanted)


def test_blocks_leave_the_same_texts(spark):
    """Cleaning over several blocks, hits broadcast or shuffled, equals cleaning over one."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.choice([4, 12, 25])))) for i in range(12)]
    rows: list[tuple] = [(None, None), (None, items[1][1]), (1, ""), (2, None)]
    for i in range(3, 60):
        around = [word() for _ in range(r.randrange(40))]
        at = r.randrange(len(around) + 1)
        middle = r.choice(items)[1] if r.random() < 0.5 else ""
        rows.append((i, " ".join([*around[:at], middle, r.choice(items)[1] if r.random() < 0.2 else "", *around[at:]])))
    rows += rows[5:9]
    docs, benchmark = frames(spark, rows, items)
    one = sorted(map(tuple, clean(docs, benchmark).select("doc_id", "text").collect()), key=repr)
    assert 0 < len(one) < len(rows)
    for bound in (decontaminate.BROADCAST_HITS, 0):
        decontaminate.BROADCAST_HITS, before = bound, decontaminate.BROADCAST_HITS
        try:
            found = clean(docs, benchmark, block_words=120)
            assert sorted(map(tuple, found.select("doc_id", "text").collect()), key=repr) == one
            assert found.columns == docs.columns
        finally:
            decontaminate.BROADCAST_HITS = before


def test_repetitive_text_beside_a_short_item():
    """The cost is linear: a state leads straight to its short items."""
    automaton = Automaton([("a", [b"w"]), ("b", [b"w"] * 200), ("c", [b"w"] * 3)], 10)
    start = time.perf_counter()
    spans, names = automaton.hits([b"w"] * 100_000)
    assert time.perf_counter() - start < 10
    assert spans == [(0, 100_000)] and names == {"a", "b", "c"}


def test_a_packed_automaton_is_small_and_equals_itself():
    r = random.Random(9)
    items = [(str(k), [b"%d" % r.randrange(3000) for _ in range(200)]) for k in range(100)]
    automaton = Automaton(items, 10)
    packed = pickle.dumps(automaton, protocol=5)
    assert len(packed) < 100 * 20_000
    text = items[3][1][20:60] + [b"x"] + items[5][1][:9] + items[7][1]
    assert pickle.loads(packed).hits(text) == automaton.hits(text) == ([(0, 40), (50, 250)], {"3", "7"})


def test_empty_tables(spark):
    docs, none = frames(spark, [(1, "some words")], [])
    assert [(r.n_words, r.spans, r["items"]) for r in scan(docs, none).collect()] == [(2, [], [])]
    assert scan(documents(spark, []), none).count() == 0
    assert clean(documents(spark, []), none).count() == 0


def test_clean_cuts_passages_and_drops_what_they_fill(spark):
    passage = "one two three four five six seven eight nine ten"
    around = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs, benchmark = frames(
        spark, [(1, f"{around}, {passage}. {around}!"), (2, f"{passage} end"), (3, around), (4, None), (None, "")], [(1, passage)]
    )
    kept = {r.doc_id: r.text for r in clean(docs, benchmark).collect()}
    assert kept == {1: f"{around}, . {around}!", 3: around, 4: None, None: ""}
    assert clean(docs, benchmark).columns == docs.columns


def test_all_documents_against_brute_force(spark):
    table = lambda name: pq.read_table(f"{SF}/{name}.parquet").to_pylist()
    items = [(str(r["item_id"]), r["text"]) for r in table("benchmark")]
    automaton = Automaton([(i, words(t.encode())) for i, t in items], decontaminate.WINDOW)
    for r in table("documents"):
        spans, names = automaton.hits(words((r["text"] or "").encode()))
        n, hit, found = brute(items, r["text"], 10)
        assert (sum(b - a for a, b in spans), names) == (len(hit), found)

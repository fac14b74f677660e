"""Quality rules against a plain count and hand cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from dayrank.llm import quality
from tests.llm.helpers import documents

PROSE = "the cat of the house and a dog in the rain saw that it was good to be home with a friend for tea".split()


def prose(n: int, seed: int = 0) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + rng.choice(["", "", "", str(rng.randrange(99))]) for _ in range(n))


def counted(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    symbols = sum(c in quality.SYMBOLS for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TEXTS = [
    None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "a a a a a", "x y z", "é ü 😀 中文 # $%",
    "same line\nsame line\n\nsame line\r\n \n \nother", "#*$%&|<> |\n|", prose(400), prose(60, 2) + "\n" + prose(60, 2),
    "spam " * 3000, prose(20_000, 3), "w" * 50_000, "\u001c word\u0085word  ",
]


def test_base_counts_equal_a_plain_count(spark):
    docs = documents(spark, list(enumerate(TEXTS)) + [(None, "a b c a b c"), (3, "one")])
    found = quality.rules(docs).collect()
    assert len(found) == len(TEXTS) + 2
    for row in found:
        text = TEXTS[row.doc_id] if row.doc_id is not None else "a b c a b c"
        assert tuple(row[c] for c in COUNTS) == counted(text), text
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)
        assert row.kept is not None and not (row.base_failed and row.kept)


def test_windows_beyond_the_hashed_places_are_sorted_by_words(spark, monkeypatch):
    texts = [prose(300, 4), "a b c d a b c", "spam " * 100]
    monkeypatch.setattr(quality, "PLACE_BITS", 3)
    docs = documents(spark, list(enumerate(texts)))
    found = docs.select("doc_id", quality.repeated_words(quality.words_of(docs.text)).alias("n")).collect()
    assert {r.doc_id: r.n for r in found} == {i: counted(t)[4] for i, t in enumerate(texts)}


def distance(p: dict, q: dict) -> float:
    def half(a: float, b: float) -> float:
        return a * math.log2(2 * a / (a + b)) / 2 if a > 0 else 0.0

    keys = p.keys() | q.keys()
    total = sum(half(p.get(k, 0), q.get(k, 0)) + half(q.get(k, 0), p.get(k, 0)) for k in keys)
    return math.sqrt(max(total, 0))


def test_distances_equal_a_plain_model(spark):
    texts = [prose(150, s) for s in range(8)] + ["THE CAT!! " * 120, " | ".join(prose(300, 9).split()), prose(120, 30)]
    langs = ["en"] * 9 + [None, "de"]
    docs = documents(spark, list(enumerate(texts))).drop("lang")
    lang = spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string")
    found = {r.doc_id: r for r in quality.rules(docs.join(lang, "doc_id")).collect()}

    def classes(words: list[str]) -> Counter:
        out: Counter = Counter()
        for c in "".join(words):
            kind = "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c.isdigit() \
                else "punctuation" if c in ".,;:!?'\"()-" else "other"
            out[kind] += 1
        return out

    def shares(counts: Counter) -> dict:
        return {k: n / sum(counts.values()) for k, n in counts.items()}

    for group in set(langs):
        own = [t.split() for t, x in zip(texts, langs, strict=True) if x == group]
        everything = [w for words in own for w in words]
        often = Counter(everything)
        names = [w for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]]
        ref_words = shares(Counter(w if w in names else "" for w in everything))
        ref_classes = shares(classes(everything))
        for i, t in enumerate(texts):
            if langs[i] != group:
                continue
            words = t.split()
            own_words = shares(Counter(w if w in names else "" for w in words))
            assert found[i].class_distance == pytest.approx(distance(shares(classes(words)), ref_classes), abs=1e-6)
            assert found[i].word_distance == pytest.approx(distance(own_words, ref_words), abs=1e-6)


def test_shouting_and_symbols_go_and_prose_stays(spark):
    texts = [prose(200, s) for s in range(30)]
    odd = [prose(200, 40).upper(), " ".join(w + "$$$" for w in prose(200, 41).split()), prose(200, 42).replace(" ", " | ")]
    short = ["AB " * 60]
    found = {r.doc_id: r for r in quality.rules(documents(spark, list(enumerate(texts + odd + short)))).collect()}
    assert all(found[i].kept for i in range(30))
    assert not any(found[i].kept for i in range(30, 34))
    assert found[33].class_distance is None  # shorter than what may be compared


def test_many_languages_are_joined(spark, monkeypatch):
    docs = documents(spark, [(i, prose(120, i)) for i in range(20)])
    wanted = sorted(map(tuple, quality.rules(docs).collect()))
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 0)
    assert sorted(map(tuple, quality.rules(docs).collect())) == wanted


def test_no_rows(spark):
    assert quality.rules(documents(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    docs = documents(spark, [(1, prose(100))])
    plan = quality.rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""Benchmark decontamination by a generalised suffix automaton over words.

The benchmark's items are cut into words and put into one automaton, a state for each class of
word runs that occur in the same places. Document words are streamed through it; the state names
the longest run ending at the current word that occurs in some item, and the longest matching
length is tracked beside it. Where that length reaches the window (10 words; a shorter item is a
window as a whole), the window's words are hit and the items that hold it are noted.

Only words that occur in items can be matched, and of two neighbours whose pair occurs in no
item the second starts anew with a matching length of at most 1. So numpy first cuts the stream at
such pairs, and only stretches that could hold a window are streamed. This skips no match.

The benchmark is the stated query set. It is taken in blocks of a bounded number of words. A task
builds a block's automaton and packs it into arrays; only the packed arrays of one block go through the
driver, which sends them to all tasks. One block, as usual, is one pass over the documents. More blocks
are one pass each: a pass notes the hits of the documents that have any, in a narrow table by id and
digest of the text, and hits are united by these. No process ever holds more than one block.

Defined results: a null text has no words and no hits; a document without words is clean; empty
documents or an empty benchmark give zeros; repeated document rows each get their own row;
items with equal ids count as one; an item without an id marks words as hit but is not listed;
columns beyond those named are ignored.
"""

from __future__ import annotations

import pickle
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrank.llm.common import LOWER, column, lookup, map_arrow, ready, slices, utf8
from dayrank.session import materialize

WINDOW = 10
#: Words of the benchmark in one automaton. Building one of so many takes a task about 150 MB, packed it is
#: about 12 MB and the vocabulary, and that is what is collected, broadcast and held at a time.
BLOCK_WORDS = 200_000

#: Documents with hits up to so many are broadcast to the texts; beyond, both sides are shuffled.
BROADCAST_HITS = 100_000

#: Words are runs of digits, letters and bytes above ASCII; A-Z are lower-cased.
_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
WORDS = bytes(LOWER[b] if LOWER[b] in _WORD else 0x20 for b in range(256))
_SPAN = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Automaton:
    """Generalised suffix automaton of items given as (item id or None, words).

    It is built with a dictionary for each state, about 750 bytes a word, and then packed: transitions as
    sorted numbers (state x base + word) with their targets, about 60 bytes a word and the vocabulary.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        ids = self.vocabulary
        runs = []
        for name, item in items:
            if item:
                runs.append((name, [ids.setdefault(w, len(ids) + 1) for w in item]))
        self.shortest = min([window, *(len(r) for _, r in runs)])
        self.base = len(ids) + 1
        pairs = {a * self.base + b for _, r in runs for a, b in zip(r, r[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, run in runs:
            last = 0
            for word in run:
                last = self._add(last, word)
        self._pack()
        length, link = self.length, self.link
        #: Of a state, its ancestor whose runs end with a window, and the items of these states, as pairs
        #: in the order of states.
        self.holder = array("i", [-1]) * len(link)
        by_length = np.argsort(np.array(length), kind="stable").tolist()
        for state in by_length:
            if length[state] >= window:
                up = link[state]
                self.holder[state] = self.holder[up] if length[up] >= window else state
        self.names = [name for name, _ in runs]
        held: set[tuple[int, int]] = set()
        #: Of a state, the windows shorter than WINDOW that are the whole of an item: {words: items}.
        self.whole: dict[int, dict[int, set[str]]] = {}
        for number, (name, run) in enumerate(runs):
            for _, state, size in self.stream(run):
                if size >= window:
                    if name is not None:
                        held.add((self.holder[state], number))
                elif size == len(run):
                    found = self.whole.setdefault(state, {}).setdefault(size, set())
                    if name is not None:
                        found.add(name)
        self.held = np.array(sorted(held), dtype=np.int32).reshape(-1, 2)
        #: Of a state, the nearest one up its links, itself included, that has such short windows. Their
        #: lengths fall along the links, so from there on are fewer than WINDOW.
        self.short = array("i", [0]) * len(link)
        if self.whole:
            for state in by_length:
                if state:
                    self.short[state] = state if state in self.whole else self.short[link[state]]

    def _pack(self) -> None:
        moves = [(state * self.base + word, to) for state, found in enumerate(self.next) for word, to in found.items()]
        moves.sort()
        self.moves = array("q", [m for m, _ in moves])
        self.targets = array("i", [to for _, to in moves])
        self.link, self.length = array("i", self.link), array("i", self.length)
        del self.next

    def _items(self, state: int) -> set[str]:
        low, high = np.searchsorted(self.held[:, 0], [state, state + 1])
        return {self.names[number] for number in self.held[low:high, 1].tolist()}

    def _add(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        new = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            known = nxt[at][word]
            link[new] = known if length[known] == length[at] + 1 else self._split(at, word, known)
        return new

    def _split(self, at: int, word: int, known: int) -> int:
        """A state of its own for the runs of ``known`` that are no longer than at + word."""
        nxt, link, length = self.next, self.link, self.length
        copy = len(link)
        nxt.append(dict(nxt[known]))
        link.append(link[known])
        length.append(length[at] + 1)
        link[known] = copy
        while at >= 0 and nxt[at].get(word) == known:
            nxt[at][word] = copy
            at = link[at]
        return copy

    def stream(self, run: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest matching length) of each word."""
        moves, targets, link, length, base = self.moves, self.targets, self.link, self.length, self.base
        last = len(moves)
        state = size = 0
        for at, word in enumerate(run):
            while True:
                key = state * base + word
                place = bisect_left(moves, key)
                if place < last and moves[place] == key:
                    state, size = targets[place], size + 1
                    break
                if not state:
                    size = 0
                    break
                state = link[state]
                size = length[state]
            yield at, state, size

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where ids could hold a window: maximal stretches whose neighbours' pairs occur."""
        if len(ids) < self.shortest or not len(self.pairs) and self.shortest > 1:
            return
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        key = ids[both] * self.base + ids[both + 1]
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        joined = np.zeros(len(ids) + 1, dtype=bool)  # word i hangs together with word i - 1
        if len(self.pairs):
            joined[both[self.pairs[at] == key] + 1] = True
        begins = np.flatnonzero(~joined[:-1] & (ids > 0))
        breaks = np.flatnonzero(~joined[1:]) + 1
        ends = breaks[np.searchsorted(breaks, begins, side="right")] if len(begins) else begins
        keep = ends - begins >= self.shortest
        yield from zip(begins[keep].tolist(), ends[keep].tolist(), strict=True)

    def hits(self, document: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (end exclusive, merged, in order) under windows, and the items."""
        if len(document) < self.shortest or len(self.link) == 1:
            return [], set()
        ids = np.fromiter(
            map(self.vocabulary.get, document, repeat(0)), dtype=np.int64, count=len(document)
        )
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        held: set[int] = set()

        def mark(end: int, size: int) -> None:
            begin = end - size
            while spans and spans[-1][1] >= begin:
                begin = min(begin, spans.pop()[0])
            spans.append((begin, end))

        for first, last in self.stretches(ids):
            for at, state, size in self.stream(ids[first:last].tolist()):
                end = first + at + 1
                if size >= self.window:
                    held.add(self.holder[state])
                    mark(end, self.window)
                up = self.short[state]
                while up > 0:
                    for short, names in self.whole[up].items():
                        if short <= size:
                            items |= names
                            mark(end, short)
                    up = self.short[self.link[up]]
        for state in held:
            items |= self._items(state)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


#: Bytes of a packed automaton in one row on its way to the driver.
PART_BYTES = 4 << 20


def blocks_of(benchmark: DataFrame, block_words: int, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The items as (block, item, text), and the number of blocks. An upper bound of an item's words is half
    its bytes and one; an item is never cut, so a single larger one makes a larger block."""
    bound = F.coalesce(F.octet_length(text_col), F.lit(0)) / 2 + 1
    total = benchmark.agg(F.sum(bound)).first()[0] or 0
    count = max(1, int(-(-total // block_words)))
    block = F.pmod(F.xxhash64(item_col, text_col), F.lit(count)).cast("int")
    return (
        benchmark.select(
            block.alias("block"), F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")
        ),
        count,
    )


def automaton(items: DataFrame, window: int) -> Automaton:
    """The automaton of one block, built in a task and fetched packed."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str | None, list[bytes]]] = []
        for batch in batches:
            texts = utf8(column(batch, "text"))
            rows += [(n, words(t)) for n, t in zip(column(batch, "item").to_pylist(), texts, strict=True)]
        packed = pickle.dumps(Automaton(rows, window), protocol=5)
        for at in range(0, len(packed), PART_BYTES):
            part = packed[at : at + PART_BYTES]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part], pa.binary())], ["at", "part"])

    built = map_arrow(items.select("item", "text").repartition(1), build, "at bigint, part binary")
    parts = sorted((r["at"], bytes(r["part"])) for r in built.collect())
    if not parts:  # without items no task had anything to build
        return Automaton([], window)
    return pickle.loads(b"".join(part for _, part in parts))


def passes(
    benchmark: DataFrame, window: int, block_words: int, item_col: str, text_col: str, use: Callable[[Broadcast], DataFrame]
) -> list[DataFrame]:
    """``use`` of the automaton of each block in turn, what it gives written before the next if there are
    several."""
    items, count = blocks_of(benchmark, block_words, item_col, text_col)
    spark = ready(benchmark.sparkSession)
    if count == 1:
        return [use(spark.sparkContext.broadcast(automaton(items, window)))]
    items = materialize(items, "benchmark", "block")
    found = []
    for number in range(count):
        block = spark.sparkContext.broadcast(automaton(items.filter(F.col("block") == number), window))
        found.append(materialize(use(block), "hits"))
        block.destroy()
    return found


SPANS = "array<struct<begin:int,end:int>>"
_SPAN_TYPE = pa.struct([("begin", pa.int32()), ("end", pa.int32())])


def scanned(
    docs: DataFrame, block: Broadcast, id_col: str, text_col: str, hits_only: bool = False
) -> DataFrame:
    """(id, digest, n_words, spans, items) of the document rows, or of those with hits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            kept, digests, counts, spans, names = [], [], [], [], []
            for at, text in enumerate(utf8(column(batch, text_col))):
                document = words(text)
                hit, found = block.value.hits(document)
                if hits_only and not hit:
                    continue
                kept.append(at)
                digests.append(xxhash.xxh3_128_digest(text) if hits_only else None)
                counts.append(len(document))
                spans.append([{"begin": a, "end": b} for a, b in hit])
                names.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, id_col).take(pa.array(kept, pa.int32())),
                    pa.array(digests, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(_SPAN_TYPE)),
                    pa.array(names, pa.list_(pa.string())),
                ],
                [id_col, "digest", "n_words", "spans", "items"],
            )

    schema = f"`{id_col}` {kind}, digest binary, n_words bigint, spans {SPANS}, items array<string>"
    return map_arrow(docs.select(id_col, text_col), run, schema)


def digests(docs: DataFrame, text_col: str) -> DataFrame:
    """The documents with the digest of their text, and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = utf8(column(batch, text_col))
            made = [pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())]
            made.append(pa.array([len(words(t)) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "__digest", "__n_words"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, f"{fields}, __digest binary, __n_words bigint")


def united(found: list[DataFrame], id_col: str) -> DataFrame:
    """(__id, __digest, __spans, __items): the hits of all passes for each id and text that has any. Rows
    with equal id and text have equal hits."""
    every = reduce(DataFrame.unionByName, (f.select(id_col, "digest", "spans", "items") for f in found))
    return every.groupBy(F.col(id_col).alias("__id"), F.col("digest").alias("__digest")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("__spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"),
    )


def _merge(spans: Column) -> Column:
    """Spans in order, those that touch joined into one."""

    def one(out: Column, span: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.array(
            F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        )
        head = F.slice(out, F.lit(1), F.size(out) - 1)
        touches = (F.size(out) > 0) & (span["begin"] <= F.get(out, F.size(out) - 1)["end"])
        return F.when(touches, F.concat(head, joined)).otherwise(F.concat(out, F.array(span)))

    return F.aggregate(spans, F.array().cast(SPANS), one)


def with_hits(docs: DataFrame, found: list[DataFrame], id_col: str, text_col: str) -> DataFrame:
    """The documents with ``__n_words``, ``__spans`` and ``__items`` of all passes. Hits are joined by id and
    digest, so no key is hot but a row that repeats, and are broadcast while they are few."""
    hits = lookup(materialize(united(found, id_col), "united"), BROADCAST_HITS)
    rows = digests(docs, text_col)
    on = rows[id_col].eqNullSafe(hits["__id"]) & (rows["__digest"] == hits["__digest"])
    none = F.array().cast(SPANS)
    return rows.join(hits, on, "left").select(
        *(rows[c] for c in docs.columns),
        "__n_words",
        _merge(F.coalesce("__spans", none)).alias("__spans"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("__items"),
    )


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, n_words, spans of hit words, item ids as sorted strings) of every document row."""
    items, count = blocks_of(benchmark, block_words, item_col, item_text_col)
    narrow = docs.select(id_col, text_col)
    found = passes(
        benchmark, window, block_words, item_col, item_text_col,
        lambda block: scanned(narrow, block, id_col, text_col, hits_only=count > 1),
    )
    if count == 1:
        return found[0].select(id_col, "n_words", "spans", "items")
    return with_hits(narrow, found, id_col, text_col).select(
        id_col, F.col("__n_words").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items")
    )


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between those words."""
    if not spans:
        return text
    places = [m.span() for m in _SPAN.finditer(text.translate(WORDS))]
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    out.append(text[at:])
    return b"".join(out)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_span: int = WINDOW,
    max_coverage: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents, all columns kept, without spans of at least ``min_span`` hit words (a hit
    that is the whole of a shorter item always goes). A document of whose words more than
    ``max_coverage`` are hit is left out. A document without hits passes as it is, null text
    included."""
    items, count = blocks_of(benchmark, block_words, item_col, item_text_col)
    schema = docs.schema

    def cleaned(frame: DataFrame, spans_of: Callable[[pa.RecordBatch, int, list[bytes]], list[tuple[int, int]]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                values = column(batch, text_col)
                kept, texts = [], []
                for at, text in enumerate(utf8(values)):
                    document = words(text)
                    spans = spans_of(batch, at, document)
                    if sum(b - a for a, b in spans) > max_coverage * len(document):
                        continue
                    kept.append(at)
                    spans = [(a, b) for a, b in spans if b - a >= min(min_span, window) or b - a < window]
                    texts.append(cut(text, spans) if values[at].is_valid else None)
                taken = batch.select(schema.names).take(pa.array(kept, pa.int32()))
                arrays = [
                    pa.array(texts, pa.binary()).cast(pa.string()) if f.name == text_col else a
                    for f, a in zip(taken.schema, taken.columns, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(arrays, taken.schema.names)

        ready(docs.sparkSession)
        return frame.mapInArrow(run, schema)

    if count == 1:

        def at_once(block: Broadcast) -> DataFrame:
            return cleaned(docs, lambda batch, at, document: merged(block.value.hits(document)[0]))

        return passes(benchmark, window, block_words, item_col, item_text_col, at_once)[0]

    narrow = docs.select(id_col, text_col)
    found = passes(
        benchmark, window, block_words, item_col, item_text_col,
        lambda block: scanned(narrow, block, id_col, text_col, hits_only=True),
    )

    def stored(batch: pa.RecordBatch, at: int, document: list[bytes]) -> list[tuple[int, int]]:
        return [(s["begin"], s["end"]) for s in column(batch, "__spans")[at].as_py()]

    return cleaned(with_hits(docs, found, id_col, text_col).drop("__n_words", "__items"), stored)

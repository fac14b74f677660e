"""Toxicity by class-conditional Kneser-Ney models.

Two models over bytes (A-Z lower-cased), one for toxic and one for ordinary text, each give the
probability of a byte after the four before it: the class's own discounted counts, and for what
they leave over a backoff that both classes share, the Kneser-Ney continuation counts (in how many
different surroundings a byte follows three others). So a rare expression is not toxic merely
because one class has not met it. Where both classes know nothing the backoff is uniform.

A text is compared by length-normalised log-likelihoods: the mean log ratio of the two models over
the whole text, and over its most toxic passage of PASSAGE bytes, since a few words make a long
text toxic. A logistic regression turns both into a score.

Counts come from all labelled rows outside the held-out fold, over whole texts, gathered with a
grouped sum; an expression counts once a text, so that a text that repeats one line a thousand times
does not decide what that line means. All counts are exact: no two expressions share one. Up to
BROADCAST_ROWS rows of counts are sent to the workers as sorted arrays; beyond, the distinct 5-grams
of blocks of texts are joined with them, by the same formula. The regression is fitted on at most FIT_ROWS rows of one fold, chosen by a hash of their id and compared by models
of the other folds' counts; then that fold's counts are added.

Defined results: a null or empty text has a mean and passage of 0 and gets the regression's answer
to that; without toxic or without ordinary rows to learn from every score is the share of toxic rows
(0 without any); labels other than 0 and 1 are ignored, a document labelled both ways is toxic;
repeated rows each get a row; a null id is scored and not learned from. Columns beyond those named
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrank.llm.common import LOWER, column, lookup, map_arrow, slices, utf8
from dayrank.session import materialize

FOLDS = 5
HELD_OUT = 0
FIT_FOLD = 4
FIT_ROWS = 20_000
PASSAGE = 16
#: What the shared backoff takes off each of its counts.
SHORT_DISCOUNT = 0.75
#: Labels up to so many rows are broadcast to the texts; beyond, both sides are shuffled.
BROADCAST_LABELS = 2_000_000
#: Counts of 5-grams, 4-byte contexts, 4-grams and 3-byte contexts are broadcast up to so many rows
#: in all (24 bytes each at most); beyond, they are joined.
BROADCAST_ROWS = 4_000_000
#: The four tables of counts and how many numbers each holds.
KINDS = {"gram": 2, "context": 4, "short": 1, "short_context": 2}
#: Bytes worked on at once, and distinct 5-grams a task gathers before it hands them on.
CHUNK = 1 << 18
GATHERED = 1_000_000

_KINDS = list(KINDS)


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


@dataclass
class Pieces:
    """Texts cut into pieces of bounded length. A piece begins with up to PASSAGE - 1 bytes of
    the one before it, and is preceded by the four bytes before that (line ends at the start)."""

    bytes: np.ndarray
    starts: np.ndarray  # of pieces, the four leading bytes included
    leads: np.ndarray  # repeated bytes behind those four
    owners: np.ndarray  # the text each belongs to

    @classmethod
    def of(cls, texts: list[bytes]) -> Iterator[Pieces]:
        parts, leads, owners, size = [], [], [], 0
        for owner, text in enumerate(texts):
            for at in range(0, len(text), CHUNK):
                lead = min(at, PASSAGE - 1)
                head = text[max(0, at - lead - 4) : at - lead] if at else b""
                parts.append(head.rjust(4, b"\n") + text[at - lead : at + CHUNK])
                leads.append(lead)
                owners.append(owner)
                size += len(parts[-1])
                if size >= CHUNK:
                    yield cls._made(parts, leads, owners)
                    parts, leads, owners, size = [], [], [], 0
        if parts:
            yield cls._made(parts, leads, owners)

    @classmethod
    def _made(cls, parts: list[bytes], leads: list[int], owners: list[int]) -> Pieces:
        lengths = np.array([len(p) for p in parts])
        flat = np.frombuffer(b"".join(parts).translate(LOWER), dtype=np.uint8)
        return cls(flat, np.cumsum(lengths) - lengths, np.array(leads), np.array(owners))

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(5-gram ending at each byte that is not one of the leading four, its piece, whether it
        is no repeated byte). The oldest byte is the most significant."""
        lengths = np.diff(np.append(self.starts, len(self.bytes)))
        piece = np.repeat(np.arange(len(lengths)), lengths)
        offset = np.arange(len(self.bytes)) - self.starts[piece]
        x = self.bytes.astype(np.uint64)
        codes = x.copy()
        for back in range(1, 5):
            codes[back:] |= x[:-back] << np.uint64(8 * back)
        inside = offset >= 4
        return codes[inside], piece[inside], (offset >= 4 + self.leads[piece])[inside]


def _summed(codes: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else order
    if not len(codes):
        return (codes, *counts)
    return (codes[first], *(np.add.reduceat(c[order], first) for c in counts))


def count_grams(labelled: DataFrame, text_col: str, *by: str) -> DataFrame:
    """(gram, n0, n1): in how many ordinary and toxic texts each 5-gram stands; with a boolean
    column ``by`` also (m0, m1), n for the rows where it is false and m where it is true. A text
    that repeats itself counts once (a very long one once for each CHUNK of it)."""
    names = ["n0", "n1", "m0", "m1"][: 2 << len(by)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[np.ndarray]) -> pa.RecordBatch:
            arrays = [pa.array(x.astype(np.int64)) for x in rows]
            return pa.RecordBatch.from_arrays(arrays, ["gram", *names])

        def nothing() -> list[list[np.ndarray]]:
            return [[] for _ in range(1 + len(names))]

        held = nothing()
        for batch in slices(batches, text_col):
            flags = (column(batch, x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("toxic", *by))
            group = sum(x << k for k, x in enumerate(flags))
            for pieces in Pieces.of(utf8(column(batch, text_col))):
                codes, piece, own = pieces.grams()
                # Text and gram in one number: 24 and 40 bits.
                once = np.unique((pieces.owners[piece].astype(np.uint64) << np.uint64(40) | codes)[own])
                groups = group[(once >> np.uint64(40)).astype(np.int64)]
                for at in range(len(names)):
                    mine = once[groups == at] & np.uint64((1 << 40) - 1)
                    gram, n = np.unique(mine, return_counts=True)
                    zero = np.zeros(len(n), dtype=np.int64)
                    for k, to in enumerate(held):
                        to.append(gram if k == 0 else n if k == at + 1 else zero)
            if sum(map(len, held[0])) > GATHERED:
                held = [[x] for x in _summed(*map(np.concatenate, held))]
                if len(held[0][0]) > GATHERED // 2:
                    yield batch_of([x[0] for x in held])
                    held = nothing()
        if held[0]:
            yield batch_of(list(_summed(*map(np.concatenate, held))))

    schema = ", ".join(f"{x} bigint" for x in ("gram", *names))
    counted = map_arrow(labelled.select(text_col, "toxic", *by), run, schema)
    return counted.groupBy("gram").agg(*(F.sum(x).alias(x) for x in names))


def counts(grams: DataFrame) -> DataFrame:
    """(kind, code, a, b, c, d), a row for each expression. gram: counts of both classes; context:
    counts and numbers of different followers of both; short: in how many surroundings a 4-gram
    stands, whatever the class; short_context: the same of all its followers, and their number."""
    one, none = F.count(F.lit(1)), F.lit(0).cast("long")

    def kind(name: str, rows: DataFrame) -> DataFrame:
        numbers = (F.col(x) if at < KINDS[name] else none.alias(x) for at, x in enumerate("abcd"))
        return rows.select(F.lit(_KINDS.index(name)).cast("long").alias("kind"), "code", *numbers)

    contexts = grams.groupBy(F.shiftright("gram", 8).alias("code")).agg(
        F.sum("n0").alias("a"),
        F.sum("n1").alias("b"),
        F.count_if(F.col("n0") > 0).alias("c"),
        F.count_if(F.col("n1") > 0).alias("d"),
    )
    shorts = grams.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)).alias("code")).agg(one.alias("a"))
    short_contexts = shorts.groupBy(F.shiftright("code", 8).alias("code")).agg(F.sum("a").alias("a"), one.alias("b"))
    parts = [grams.selectExpr("gram AS code", "n0 AS a", "n1 AS b"), contexts, shorts, short_contexts]
    return reduce(DataFrame.unionByName, map(kind, _KINDS, parts))


def _ratio(per_kind: dict[str, np.ndarray], discounts: tuple[float, float]) -> np.ndarray:
    """The log ratio of the models from the counts of a 5-gram and its parts, 0 where unknown."""
    context, short, short_context = (per_kind[x].astype(float) for x in ("context", "short", "short_context"))
    gram = np.maximum(per_kind["gram"].astype(float) - np.array(discounts), 0)
    total, followers = short_context.T
    #: What the backoff's own discount leaves over is spread evenly over all bytes.
    rest = np.where(total > 0, SHORT_DISCOUNT * followers / np.maximum(total, 1), 1)
    shared = np.maximum(short[:, 0] - SHORT_DISCOUNT, 0) / np.maximum(total, 1) + rest / 256
    n, types = context[:, :2], context[:, 2:]
    left_over = np.where(n > 0, np.array(discounts) * types / np.maximum(n, 1), 1)
    p = gram / np.maximum(n, 1) + left_over * shared[:, None]
    # In 24 bits, so that sums of many are the same whatever stands before them.
    return (np.log(p[:, 1]) - np.log(p[:, 0])).astype(np.float32)


class Likelihoods:
    """Both models, in sorted arrays."""

    def __init__(self, rows: pa.Table, discounts: tuple[float, float]):
        kind, code = rows["kind"].to_numpy(), rows["code"].to_numpy().astype(np.uint64)
        numbers = [rows[x].to_numpy() for x in "abcd"]
        self.discounts, self.codes, self.counts = discounts, {}, {}
        for at, (name, width) in enumerate(KINDS.items()):
            mine = np.flatnonzero(kind == at)
            mine = mine[np.argsort(code[mine])]
            found = np.stack([x[mine] for x in numbers[:width]], axis=1)
            self.codes[name] = code[mine]
            self.counts[name] = found.astype(np.uint32) if found.max(initial=0) < 1 << 32 else found

    def _found(self, name: str, codes: np.ndarray) -> np.ndarray:
        known = self.codes[name]
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return self.counts[name][at] * (known[at] == codes)[:, None]

    def log_ratio(self, codes: np.ndarray) -> np.ndarray:
        codes, back = np.unique(codes, return_inverse=True)
        short = codes & np.uint64(0xFFFFFFFF)
        eight = np.uint64(8)
        parts = dict(zip(_KINDS, (codes, codes >> eight, short, short >> eight), strict=True))
        return _ratio({name: self._found(name, x) for name, x in parts.items()}, self.discounts)[back]

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean log ratio, that of the most toxic passage, bytes) of each text."""
        total = np.zeros(len(texts))
        peak = np.full(len(texts), -np.inf)
        size = np.array([len(t) for t in texts])
        for pieces in Pieces.of(texts):
            codes, piece, own = pieces.grams()
            ratio = self.log_ratio(codes).astype(np.float64)
            np.add.at(total, pieces.owners, np.bincount(piece, ratio * own, len(pieces.owners)))
            sums = np.concatenate([[0], np.cumsum(ratio)])
            first = np.searchsorted(piece, np.arange(len(pieces.owners)))
            at = np.arange(len(ratio))
            passage = sums[at + 1] - sums[np.maximum(at + 1 - PASSAGE, first[piece])]
            passage[~own] = -np.inf
            np.maximum.at(peak, pieces.owners, np.maximum.reduceat(passage, first))
        return total / np.maximum(size, 1), np.where(size > 0, peak, 0) / PASSAGE, size


class Known(Likelihoods):
    """The log ratios of the 5-grams of one block of texts, all of them."""

    def __init__(self, codes: np.ndarray, ratios: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.ratios = codes[order], ratios[order]

    def log_ratio(self, codes: np.ndarray) -> np.ndarray:
        return self.ratios[np.searchsorted(self.codes, codes)]


@dataclass
class Tables:
    """The counts of both models as a table, and if it is small enough, broadcast."""

    rows: DataFrame
    discounts: tuple[float, float]
    likelihoods: Broadcast | None

    @classmethod
    def of(cls, grams: DataFrame) -> Tables | None:
        """Those of (gram, n0, n1); none without ordinary or without toxic texts."""
        totals = grams.agg(
            *(F.sum(F.col(c)).alias(c) for c in ("n0", "n1")),
            *(F.count_if(F.col(c) == n).alias(f"{c}_{n}") for c in ("n0", "n1") for n in (1, 2)),
        ).first()
        if not totals["n0"] or not totals["n1"]:
            return None

        def discount(once: int, twice: int) -> float:
            return once / (once + 2 * twice) if once and twice else 0.5

        discounts = discount(totals["n0_1"], totals["n0_2"]), discount(totals["n1_1"], totals["n1_2"])
        rows = materialize(counts(grams), "counts")
        if rows.count() > BROADCAST_ROWS:
            return cls(rows, discounts, None)
        likelihoods = Likelihoods(rows.toArrow(), discounts)
        return cls(rows, discounts, grams.sparkSession.sparkContext.broadcast(likelihoods))

    def ratios(self, grams: DataFrame) -> DataFrame:
        """(gram, ratio) of distinct 5-grams, by a join with each kind of counts."""
        short = F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF))
        code = (F.col("gram"), F.shiftright("gram", 8), short, F.shiftright(short, 8))
        found = grams
        for at, (name, width) in enumerate(KINDS.items()):
            names = [f"{name}_{k}" for k in range(width)]
            numbers = [F.col(x).alias(to) for x, to in zip("abcd", names, strict=False)]
            known = self.rows.filter(F.col("kind") == at).select(F.col("code").alias(f"{name}_code"), *numbers)
            found = found.join(known, code[at] == F.col(f"{name}_code"), "left").drop(f"{name}_code").fillna(0, names)
        discounts = self.discounts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                per_kind = {
                    name: np.stack([column(batch, f"{name}_{k}").to_numpy() for k in range(width)], axis=1)
                    for name, width in KINDS.items()
                }
                ratio = pa.array(_ratio(per_kind, discounts))
                yield pa.RecordBatch.from_arrays([column(batch, "gram"), ratio], ["gram", "ratio"])

        return map_arrow(found, run, "gram bigint, ratio float")


def _with_features(batch: pa.RecordBatch | pa.Table, likelihoods: Likelihoods, text: pa.Array, names: list[str]) -> list:
    mean, peak, size = likelihoods.features(utf8(text))
    numbers = [pa.array(mean), pa.array(peak), pa.array(size.astype(np.int64))]
    return [*(batch.column(batch.schema.get_field_index(c)) for c in names), *numbers]


@dataclass
class Model:
    tables: Tables | None
    weights: np.ndarray
    share: float

    def features(self, docs: DataFrame, id_col: str, text_col: str, *also: str) -> DataFrame:
        """(id, mean, peak, n_bytes), and further columns."""
        names = [id_col, *also]
        kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
        schema = f"{kinds}, mean double, peak double, n_bytes bigint"
        docs = docs.select(*dict.fromkeys([id_col, text_col, *also]))
        likelihoods = self.tables.likelihoods
        if likelihoods is None:
            return self._joined(docs, text_col, names, schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                arrays = _with_features(batch, likelihoods.value, column(batch, text_col), names)
                yield pa.RecordBatch.from_arrays(arrays, [*names, "mean", "peak", "n_bytes"])

        return map_arrow(docs, run, schema)

    def _joined(self, docs: DataFrame, text_col: str, names: list[str], schema: str) -> DataFrame:
        """The same with counts that are not broadcast. Texts are dealt into blocks, the slices a
        task works on; a block gets the ratios of its own 5-grams."""
        fields = docs.columns

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                block = pa.array(np.full(batch.num_rows, uuid.uuid4().int >> 65, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([block, *batch.columns], ["__block", *fields])

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks = column(batch, "__block").to_numpy()
                for block in np.unique(blocks):
                    mine = batch.filter(pa.array(blocks == block))
                    grams = [np.unique(p.grams()[0]) for p in Pieces.of(utf8(column(mine, text_col)))]
                    gram = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *grams])).astype(np.int64)
                    arrays = [pa.array(np.full(len(gram), block)), pa.array(gram)]
                    yield pa.RecordBatch.from_arrays(arrays, ["__block", "gram"])

        def scored(texts: pa.Table, known: pa.Table) -> pa.Table:
            ratios = Known(known["gram"].to_numpy().astype(np.uint64), known["ratio"].to_numpy())
            text = texts[text_col].combine_chunks()
            arrays = _with_features(texts, ratios, text, names)
            return pa.Table.from_arrays(arrays, [*names, "mean", "peak", "n_bytes"])

        kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in fields)
        dealt = materialize(map_arrow(docs, deal, f"__block bigint, {kinds}"), "blocks")
        grams = materialize(map_arrow(dealt, distinct, "__block bigint, gram bigint").distinct(), "block-grams")
        ratios = grams.join(self.tables.ratios(grams.select("gram").distinct()), "gram")
        return dealt.groupBy("__block").cogroup(ratios.groupBy("__block")).applyInArrow(scored, schema)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *also: str) -> DataFrame:
        """(id, score 0 to 1, mean, peak), and further columns. ``also`` may not clash with these."""
        if self.tables is None:
            nothing = F.lit(0.0)
            return docs.select(
                id_col, *also, F.lit(self.share).alias("score"), nothing.alias("mean"), nothing.alias("peak")
            )
        weights = [float(w) for w in self.weights]
        names = ("mean", "peak")
        z = F.lit(weights[0]) + sum(F.col(n) * w for n, w in zip(names, weights[1:], strict=True))
        return self.features(docs, id_col, text_col, *also).select(
            id_col, *also, (1 / (1 + F.exp(-z))).alias("score"), *names
        )


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the constant first) of a logistic regression, by Newton's method."""
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    a = np.column_stack([np.ones(len(x)), (x - center) / scale])
    w = np.zeros(a.shape[1])
    penalty = ridge * len(x) * np.diag([0.0, *[1.0] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty
        step = np.linalg.solve(hessian, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[0] - (w[1:] * center / scale).sum(), w[1:] / scale)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
    held_out: int | None = HELD_OUT,
) -> Model:
    """A model from the labelled rows that are not of the held-out fold (none: from all)."""
    fit_fold = FIT_FOLD if held_out != FIT_FOLD else FIT_FOLD - 1
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(id_col)
        .agg(F.max(label_col).alias("toxic"))
    )
    if held_out is not None:
        known = known.filter(fold(id_col) != held_out)
    known = lookup(known, BROADCAST_LABELS)
    labelled = docs.select(id_col, text_col).join(known, id_col).withColumn("fitting", fold(id_col) == fit_fold)
    grams = materialize(count_grams(labelled, text_col, "fitting"), "grams")
    every = grams.select("gram", (F.col("n0") + F.col("m0")).alias("n0"), (F.col("n1") + F.col("m1")).alias("n1"))
    tables = Tables.of(every)
    if tables is None:
        share = known.agg(F.avg("toxic")).first()[0]
        return Model(None, np.zeros(3), float(share or 0.0))
    return Model(tables, _weights(docs, known, grams, fit_fold, id_col, text_col, fit_rows), 0.0)


def _weights(
    docs: DataFrame, known: DataFrame, grams: DataFrame, fit_fold: int, id_col: str, text_col: str, fit_rows: int
) -> np.ndarray:
    """The regression's weights, from rows of the fitting fold against the counts of the others."""
    #: Nothing to fit on: a passage that the toxic model likes better by e a byte is toxic.
    otherwise = np.array([-1.0, 1.0, 1.0])
    others = Tables.of(grams.select("gram", "n0", "n1").filter("n0 + n1 > 0"))
    if others is None:
        return otherwise
    chosen = (
        known.filter(fold(id_col) == fit_fold)
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(fit_rows)
        .select(id_col, "toxic")
    )
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    rows = Model(others, otherwise, 0.0).features(sample, id_col, text_col, "toxic").toArrow()
    if others.likelihoods is not None:
        others.likelihoods.unpersist()
    x = np.stack([rows["mean"].to_numpy(), rows["peak"].to_numpy()], axis=1)
    y = rows["toxic"].to_numpy().astype(float)
    return regression(x, y) if 0 < y.sum() < len(y) else otherwise

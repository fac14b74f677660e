"""Centroid clustering in integers, with centroids ruled out in rotated coordinates.

Each vector becomes integers, floor(SCALE x component). Clusters are those of Lloyd's rounds: the first
centroids are the vectors with the smallest hashes of their ids; each round assigns every vector to
the nearest centroid (squared Euclidean distance, ties to the smaller number) and moves every
centroid that has vectors to their componentwise floor of the mean. All of that is exact.

What makes it cheap is stored once beside the integers: the first LEADING coordinates in the basis of
the principal components, counted over all vectors, and the norm of the rest. For a vector and a centroid
the squared distance in the leading coordinates plus the squared difference of the two rests is never
more than the squared distance. So the exact distance to the centroid with the least bound
rules out all centroids whose bound is larger, and only the others are computed, in integers. The
bounds are floating-point numbers: they are lowered by more than their rounding can be, so no
centroid is ruled out wrongly, whatever the basis.

A round is one pass over the stored table; what is shuffled are sums of a cluster's vectors,
combined within a task, and what the driver sees are the centroids (K x DIMENSIONS numbers)
and one matrix of DIMENSIONS x DIMENSIONS sums.

Vectors that are null, have another number of components, or hold null or non-finite ones are left
out. Rows that repeat are vectors of their own; of vectors with equal hashes those with smaller
components come first. A null id is hashed as an empty one. Fewer than K vectors give as many centroids as
there are vectors; none give no rows. Components are integers of any size: those beyond
FAST are computed without a bound on digits, and a distance or inertia beyond a long is null. Other
columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrank.llm.common import column, map_arrow
from dayrank.session import materialize

DIMENSIONS = 64
SCALE = 256
K = 40
ROUNDS = 5
#: Rotated coordinates that are stored; the rest is stored as a norm.
LEADING = 16
#: Largest component for which distances of DIMENSIONS components fit into 64 bits.
FAST = 1 << 27
#: Vectors with larger components are compared with every centroid: their squares are no doubles.
ROTATED = 1e100
#: By how much bounds are lowered, as a share of the numbers they are computed from.
SLACK = 1e-9
LONG = (1 << 63) - 1
#: Pairs of a vector and a centroid that are computed at once.
PAIRS = 1 << 15


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The vectors that take part, as ``__id`` and ``__x``, their integers. Where they go beyond FAST
    the components themselves are in ``__big`` instead."""
    x = F.col("__v")
    usable = vectors.select(
        F.col(id_col).alias("__id"), F.col(vector_col).cast("array<double>").alias("__v")
    ).filter(
        (F.size(x) == DIMENSIONS)
        & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    small = F.forall(x, lambda c: F.abs(c) * SCALE <= FAST)
    return usable.select(
        "__id",
        F.when(small, F.transform(x, lambda c: F.floor(c * SCALE).cast("int"))).alias("__x"),
        F.when(~small, x).alias("__big"),
    )


def integers(batch: pa.RecordBatch) -> np.ndarray:
    """The integers of a batch: 64-bit where all are small, else Python's."""
    big = column(batch, "__big")
    if big.null_count == batch.num_rows:
        return column(batch, "__x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS)
    rows = [
        [int(v) for v in x] if x is not None else [scaled(v) for v in b]
        for x, b in zip(column(batch, "__x").to_pylist(), big.to_pylist(), strict=True)
    ]
    return np.array(rows, dtype=object).reshape(-1, DIMENSIONS)


def floats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers as doubles, and which rows are within ROTATED; others are zero."""
    if x.dtype != object:
        return x.astype(np.float64), np.ones(len(x), dtype=bool)
    inside = np.array([all(abs(v) <= ROTATED for v in row) for row in x.tolist()], dtype=bool)
    out = np.zeros(x.shape)
    out[inside] = x[inside].astype(np.float64)
    return out, inside


def scaled(value: float) -> int:
    """floor(SCALE x value) without leaving a double's range."""
    top, bottom = value.as_integer_ratio()
    return top * SCALE // bottom


def first_centroids(table: DataFrame, k: int) -> list[list[int]]:
    """The vectors of the k smallest hashes, in their order."""
    text = F.concat(F.lit("2:"), F.coalesce(F.col("__id").cast("string"), F.lit("")))
    rows = (
        table.select(F.sha2(text, 256).alias("hash"), "__x", "__big")
        .orderBy("hash", F.coalesce(F.col("__x").cast("array<double>"), "__big"))
        .limit(k)
        .collect()
    )
    return [list(r["__x"]) if r["__x"] is not None else [scaled(v) for v in r["__big"]] for r in rows]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, sums and sums of products of a task's vectors, one row a task."""
    total = np.zeros((DIMENSIONS + 1, DIMENSIONS + 1))
    for batch in batches:
        if batch.num_rows:
            x, inside = floats(integers(batch))
            x = np.hstack([x, np.ones((len(x), 1))])[inside]
            total += x.T @ x
    if total[-1, -1]:
        place = pa.array(np.arange(total.size, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([place, pa.array(total.ravel())], ["place", "total"])


def rotation(table: DataFrame) -> np.ndarray:
    """The principal components of all vectors, as columns, the strongest first."""
    parts = map_arrow(table.select("__x", "__big"), _moments, "place int, total double")
    size = DIMENSIONS + 1
    moments = np.zeros(size * size)
    for row in parts.groupBy("place").agg(F.sum("total").alias("total")).collect():
        moments[row["place"]] = row["total"]
    moments = moments.reshape(size, size)
    n = max(moments[-1, -1], 1.0)
    mean = moments[-1, :-1] / n
    covariance = moments[:-1, :-1] / n - np.outer(mean, mean)
    covariance = np.nan_to_num(covariance, nan=0.0, posinf=0.0, neginf=0.0)
    return np.linalg.eigh((covariance + covariance.T) / 2)[1][:, ::-1]


def rotated(x: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates, and the norm of the others; an infinite one rules nothing out."""
    known, inside = floats(x)
    y = known @ basis
    rest = np.sqrt(np.square(y[:, LEADING:]).sum(axis=1))
    return y[:, :LEADING], np.where(inside, rest, np.inf)


def store(table: DataFrame, basis: np.ndarray) -> DataFrame:
    """The integers with their leading coordinates and the norm of the rest, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead, rest = rotated(integers(batch), basis)
                flat = pa.array(lead.ravel())
                starts = pa.array(np.arange(0, len(flat) + 1, LEADING, dtype=np.int32))
                arrays = [*batch.columns, pa.ListArray.from_arrays(starts, flat), pa.array(rest)]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "__lead", "__rest"])

    kind = dict(table.dtypes)["__id"]
    schema = f"__id {kind}, __x array<int>, __big array<double>, __lead array<double>, __rest double"
    return materialize(map_arrow(table, run, schema), "rotated")


class Centroids:
    """Centroids as integers, and in rotated coordinates."""

    def __init__(self, values: list[list[int]], basis: np.ndarray) -> None:
        fast = all(abs(v) <= FAST for row in values for v in row)
        self.values = np.array(values, dtype=np.int64 if fast else object).reshape(-1, DIMENSIONS)
        self.lead, self.rest = rotated(self.values, basis)

    def distances(self, x: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Exact squared distances of some rows from some centroids."""
        if x.dtype == object or self.values.dtype == object:
            gap = x[rows].astype(object) - self.values[numbers].astype(object)
        else:
            gap = x[rows] - self.values[numbers]
        return (gap * gap).sum(axis=1)

    def bounds(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """What the squared distances are at least."""
        own, other = np.square(lead).sum(axis=1)[:, None], np.square(self.lead).sum(axis=1)
        with np.errstate(invalid="ignore"):
            size = own + other + np.square(rest)[:, None] + np.square(self.rest)
            found = own + other - 2 * lead @ self.lead.T + np.square(rest[:, None] - self.rest)
            return np.where(np.isfinite(size), found - SLACK * size - 1, 0.0)

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid."""
        bounds = self.bounds(lead, rest)
        every = np.arange(len(x))
        number = bounds.argmin(axis=1)
        best = self.distances(x, every, number)
        limit = np.array([min(d, 10**300) for d in best.tolist()], dtype=np.float64)
        left = bounds <= (limit * (1 + SLACK))[:, None]
        left |= limit[:, None] >= 1e300
        left[every, number] = False
        rows, numbers = np.nonzero(left)
        for begin in range(0, len(rows), PAIRS):
            r, c = rows[begin : begin + PAIRS], numbers[begin : begin + PAIRS]
            found = self.distances(x, r, c)
            if found.dtype == object:
                for at, centroid, distance in zip(r.tolist(), c.tolist(), found.tolist(), strict=True):
                    if (distance, centroid) < (best[at], number[at]):
                        best[at], number[at] = distance, centroid
                continue
            # The best pair of each row first, then against what is known of the row.
            order = np.lexsort((c, found, r))
            first = order[np.concatenate([[True], np.diff(r[order]) > 0])]
            r, c, found = r[first], c[first], found[first]
            better = (found < best[r]) | ((found == best[r]) & (c < number[r]))
            best[r[better]], number[r[better]] = found[better], c[better]
        return number, best


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lead = column(batch, "__lead").flatten().to_numpy(zero_copy_only=False).reshape(-1, LEADING)
    return integers(batch), lead, column(batch, "__rest").to_numpy(zero_copy_only=False)


def moved(table: DataFrame, centroids: Centroids) -> list[list[int]]:
    """The centroids after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.values)
        sums = [[0] * DIMENSIONS for _ in range(k)]
        counts = [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            x, lead, rest = _columns(batch)
            number, _ = centroids.nearest(x, lead, rest)
            for cluster in np.unique(number).tolist():
                own = x[number == cluster]
                counts[cluster] += len(own)
                sums[cluster] = [a + int(b) for a, b in zip(sums[cluster], own.sum(axis=0).tolist(), strict=True)]
        used = [c for c in range(k) if counts[c]]
        rows = [(c, at, str(sums[c][at]), counts[c]) for c in used for at in range(DIMENSIONS)]
        fields = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(f, type=t) for f, t in zip(fields, kinds, strict=True)], ["cluster", "at", "total", "n"]
        )

    parts = map_arrow(table, run, "cluster int, at int, total string, n long")
    new = centroids.values.tolist()
    # A sum of one task has as many digits as it needs; longer ones than a decimal holds are added here.
    decimal = F.length("total") <= 28
    added = (
        parts.groupBy("cluster", "at")
        .agg(
            F.sum(F.when(decimal, F.col("total").cast("decimal(28,0)"))).alias("total"),
            F.collect_list(F.when(~decimal, F.col("total"))).alias("long"),
            F.sum("n").alias("n"),
        )
        .collect()
    )
    for row in added:
        total = int(row["total"] or 0) + sum(map(int, row["long"]))
        new[row["cluster"]][row["at"]] = total // row["n"]
    return new


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part: its id, cluster and squared distance, the distances summed over
    its cluster and over all, and the digest of its cluster's centroid."""
    table = materialize(whole(vectors, id_col, vector_col), "whole-vectors")
    values = first_centroids(table, K)
    basis = rotation(table)
    table = store(table, basis)
    for _ in range(ROUNDS if values else 0):
        values = moved(table, Centroids(values, basis))
    centroids = Centroids(values, basis)
    kind = dict(table.dtypes)["__id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, best = centroids.nearest(*_columns(batch))
                fits = [int(d) if d <= LONG else None for d in best.tolist()]
                arrays = [column(batch, "__id"), pa.array(number.astype(np.int32)), pa.array(fits, type=pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["__id", "cluster", "distance"])

    assigned = materialize(map_arrow(table, run, f"__id {kind}, cluster int, distance long"), "assigned")
    # A sum with a distance beyond a long is beyond it as well.
    known = F.count("distance") == F.count(F.lit(1))
    per_cluster = assigned.groupBy("cluster").agg(
        F.when(known, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total"), known.alias("known")
    )
    sums = {r["cluster"]: r["total"] for r in per_cluster.collect()}
    everything = None if None in sums.values() else sum(map(int, sums.values()))
    rows = [
        (
            number,
            _long(total),
            _long(everything),
            hashlib.sha256(",".join(map(str, values[number])).encode()).hexdigest(),
        )
        for number, total in sorted(sums.items())
    ]
    facts = table.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(facts), "cluster").select(
        F.col("__id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _long(value: object) -> int | None:
    return int(value) if value is not None and int(value) <= LONG else None

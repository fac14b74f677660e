"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors of a label are one class. Each tree splits the unit sphere: at each level vectors are
projected on a random direction and go left or right of the node's median; those within a margin of
it go both ways (spill), so close vectors near a cut still meet. The margin is a share of how far
vectors at the threshold differ along a random direction. Medians are fitted on FIT_ROWS rows at
most, chosen by a hash of their id; below the levels that such a sample can fill, the cut is at the
mean's place, zero. Every vector is put into the leaves of all trees. Within a leaf all cosines are
computed in double precision and links confirmed; a pair counts in the first leaf that its vectors
share, so links are counted without listing pairs, and of the links only those that join two
components leave the leaf. A leaf of more than CELL vectors is cut into blocks and each pair of
blocks is a task's work of its own.

Recall: a pair at the threshold is parted in a level with a chance of about 1.3 % and has TREES
chances; tests measure it against brute force.

Defined results: vectors that are null, zero or hold null or non-finite components, or whose label
is null, link with nothing; vectors of different length link with nothing; rows that repeat an id
are counted as vectors of their own but share a component's label where linked; a null id has no
component of its own (null) and is kept; an empty table gives an empty table; columns beyond those
named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from dayrank.llm.cells import blocked, by_cell, overlaps
from dayrank.llm.common import column, ready, map_arrow
from dayrank.llm.components import components
from dayrank.session import materialize

COSINE = 0.98
TREES = 8
#: Vectors that a leaf should hold on average, before spill.
LEAF = 256
CELL = 1000
#: Margin of a cut, in standard deviations of a threshold pair's difference along the direction.
SPILL = 0.5
FIT_ROWS = 65_536
#: A node's median needs so many fitted rows.
NODE_ROWS = 8
SEED = 20_240_101


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their class key, classes with representative and size). Unusable rows have none."""
    kind = vectors.schema[vector_col].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    element = "float" if narrow else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for values in column(batch, "vector").to_pylist():
                x = np.array([np.nan if v is None else v for v in values or []], dtype=np.float64) + 0.0
                fine = len(x) > 0 and np.isfinite(x).all() and x.any()
                keys.append(xxhash.xxh3_128_digest(x.tobytes()) if fine else None)
                units.append(x.astype(np.float32 if narrow else np.float64) if fine else None)
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "id"),
                    column(batch, "label"),
                    pa.array(keys, pa.binary()),
                    pa.array(units, pa.list_(pa.float32() if narrow else pa.float64())),
                ],
                ["id", "label", "key", "vector"],
            )

    chosen = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).alias("vector"),
    )
    schema = f"id bigint, label string, key binary, vector array<{element}>"
    rows = materialize(map_arrow(chosen, run, schema), "vectors")
    usable = rows.filter("key IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL")
    grouped = usable.groupBy("label", "key").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")
    )
    return rows, materialize(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")


class Forest:
    """Directions for each tree and level, and the medians of the nodes."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, cosine: float, spill: float):
        self.depth = depth
        width = sample.shape[1]
        random = np.random.default_rng(SEED)
        directions = random.standard_normal((trees, depth, width))
        self.directions = directions / np.linalg.norm(directions, axis=2, keepdims=True)
        self.margin = spill * np.sqrt(max(0.0, 2 * (1 - cosine)) / width)
        self.medians: list[list[np.ndarray]] = []
        for tree in range(trees):
            node = np.zeros(len(sample), dtype=np.int64)
            levels = []
            for level in range(depth):
                if len(sample) < NODE_ROWS << level:
                    break
                at = sample @ self.directions[tree, level]
                medians = np.zeros(1 << level)
                order = np.lexsort((at, node))
                nodes, first, rows = np.unique(node[order], return_index=True, return_counts=True)
                full = rows >= NODE_ROWS
                medians[nodes[full]] = at[order][(first + rows // 2)[full]]
                levels.append(medians)
                node = 2 * node + (at >= medians[node])
            self.medians.append(levels)

    def leaves(self, units: np.ndarray) -> list[np.ndarray]:
        """For each vector the sorted codes of all leaves it is in, over all trees."""
        owners, codes = [], []
        for tree, levels in enumerate(self.medians):
            at = units @ self.directions[tree].T if self.depth else np.zeros((len(units), 0))
            owner, node = np.arange(len(units)), np.zeros(len(units), dtype=np.int64)
            for level in range(self.depth):
                cut = levels[level][node] if level < len(levels) else 0.0
                gap = at[owner, level] - cut
                left, right = gap < self.margin, gap >= -self.margin
                owner = np.concatenate([owner[left], owner[right]])
                node = np.concatenate([2 * node[left], 2 * node[right] + 1])
            owners.append(owner)
            codes.append((np.int64(tree) << np.int64(40)) + node)
        owner, code = np.concatenate(owners), np.concatenate(codes)
        order = np.lexsort((code, owner))
        bounds = np.searchsorted(owner[order], np.arange(len(units) + 1))
        code = code[order]
        return [code[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _matrix(arrays: list[np.ndarray]) -> np.ndarray:
    x = np.array(arrays, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs_within(
    units: np.ndarray,
    earlier: list[np.ndarray],
    block: np.ndarray,
    weight: np.ndarray,
    cosine: float,
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(linked vectors of each class that count in this cell, links that connect its members)."""
    count = len(units)
    linked = units @ units.T >= cosine
    np.fill_diagonal(linked, False)
    if len(set(block.tolist())) > 1:  # two blocks: each has a cell of its own for its own pairs
        linked &= block[:, None] != block[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    links = np.zeros(count, dtype=np.int64)
    if not len(some):
        return links, []
    part = linked[np.ix_(some, some)] & (overlaps([earlier[i] for i in some]) == 0)
    links[some] = part.astype(np.int64) @ weight[some]
    root = np.arange(count)
    joined = []
    for i in some.tolist():
        for j in np.flatnonzero(linked[i] & (root != root[i])).tolist():
            if root[j] != root[i]:
                joined.append((i, j))
                root[root == root[j]] = root[i]
    return links, joined


def compare(groups: DataFrame, trees: int, leaf: int, cell: int, cosine: float, spill: float) -> DataFrame:
    """(kind, a, b): kind 0: a class and how many vectors of other classes it links with, in
    parts; kind 1: a link between representatives."""
    spark = ready(groups.sparkSession)
    size = F.size("vector").alias("width")
    made = []
    largest = groups.groupBy("label", size).agg(F.count(F.lit(1)).alias("n"))
    # Lengths of vectors are few; each has a forest of its own.
    for width, n in [tuple(r) for r in largest.groupBy("width").agg(F.max("n")).collect()]:
        depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        mine = groups.filter(F.size("vector") == width)
        sample = (
            mine.select("vector", "class", F.xxhash64("class").alias("at"))
            .orderBy("at", "class")
            .limit(FIT_ROWS)
            .select("vector")
            .toArrow()["vector"]
            .to_pylist()
        )
        forest = spark.sparkContext.broadcast(Forest(_matrix(sample), trees, depth, cosine, spill))
        made.append((mine, forest))

    out = None
    for mine, forest in made:

        def place(batches: Iterator[pa.RecordBatch], forest=forest) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    units = _matrix(column(batch, "vector").to_pylist())
                    codes = pa.array([c.tolist() for c in forest.value.leaves(units)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([column(batch, "class"), codes], ["class", "codes"])

        codes = map_arrow(mine.select("class", "vector"), place, "class bigint, codes array<bigint>")
        placed = materialize(mine.join(codes, "class"), "leaves")
        member = placed.select(
            "class",
            F.concat_ws(":", F.lit("v"), F.size("vector"), "label").alias("group"),
            F.posexplode("codes").alias("at", "code"),
        )
        rows = (
            blocked(member, ["group", "code"], "class", cell)
            .join(placed, "class")
            .select("cell", "block", "class", "rep", "n", "vector", F.slice("codes", F.lit(1), F.col("at")).alias("earlier"))
        )

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in by_cell(batches, ("vector", "earlier")):
                if len(rows["rep"]) < 2:
                    continue
                links, joined = pairs_within(
                    _matrix(rows["vector"]),
                    rows["earlier"],
                    np.array(rows["block"]),
                    np.array(rows["n"]),
                    cosine,
                )
                some = np.flatnonzero(links).tolist()
                kinds = [0] * len(some) + [1] * len(joined)
                a = [rows["class"][i] for i in some] + [rows["rep"][i] for i, _ in joined]
                b = links[some].tolist() + [rows["rep"][j] for _, j in joined]
                if kinds:
                    arrays = [pa.array(kinds, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["kind", "a", "b"])

        ordered = rows.repartition("cell").sortWithinPartitions("cell")
        found = map_arrow(ordered, within, "kind int, a bigint, b bigint")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "kind int, a bigint, b bigint")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    trees: int = TREES,
    leaf: int = LEAF,
    cell: int = CELL,
    spill: float = SPILL,
) -> DataFrame:
    """(id, n_links, component_id, kept) of each row."""
    rows, groups = classes(vectors, id_col, vector_col, label_col)
    found = materialize(compare(groups, trees, leaf, cell, cosine, spill), "links")
    links = found.filter("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("links"))
    labels = components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    linked = materialize(
        groups.drop("vector")
        .join(links, "class", "left")
        .join(labels, "rep", "left")
        .filter("n > 1 OR links IS NOT NULL OR component IS NOT NULL")
        .select(
            "label",
            "key",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        ),
        "linked",
    )
    component = F.coalesce("component", "id")
    return (
        rows.select("id", F.when(F.col("id").isNotNull(), F.col("label")).alias("label"), "key")
        .join(linked, ["label", "key"], "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            component.eqNullSafe(F.col("id")).alias("kept"),
        )
    )

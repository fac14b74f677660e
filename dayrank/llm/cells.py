"""Groups whose members are compared with each other, cut so that no task holds a large one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrank.llm.common import column


def blocked(members: DataFrame, keys: Sequence[str], unique: str, size: int) -> DataFrame:
    """The members (at most one row for each group and value of ``unique``) with ``cell`` and
    ``block`` instead of the group's keys.

    A group of up to ``size`` members is a cell. A larger one is cut into blocks by a hash, and
    each two blocks, and each one with itself, are a cell: every two members meet in some cell,
    and a cell has about 2 x ``size`` members at most. Groups of one are left out.
    """
    counted = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    blocks = F.ceil(F.col("__n") / size).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("__blocks") - 1),
        lambda other: F.struct(F.least("block", other).alias("low"), F.greatest("block", other).alias("high")),
    )
    return (
        members.join(counted, list(keys))
        .withColumn("__blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64(unique), F.col("__blocks")).cast("int"))
        .withColumn("__pair", F.explode(meets))
        .withColumn("cell", F.concat_ws(":", *keys, "__pair.low", "__pair.high"))
        .drop("__n", "__blocks", "__pair", *keys)
    )


def by_cell(batches: Iterator[pa.RecordBatch], lists: tuple[str, ...]) -> Iterator[tuple[str, dict[str, list[Any]]]]:
    """The rows of each cell, given rows in the order of cells."""
    name, rows = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        names = column(batch, "cell").to_pylist()
        values: dict[str, list[Any]] = {}
        for field in batch.schema.names:
            if field in lists:
                array = column(batch, field)
                flat = array.values.to_numpy(zero_copy_only=False)
                offsets = array.offsets.to_numpy()
                values[field] = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            elif field != "cell":
                values[field] = column(batch, field).to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if names[begin] != name:
                if name is not None:
                    yield name, rows
                name, rows = names[begin], {field: [] for field in values}
            for field, column_values in values.items():
                part = column_values[begin:end]
                rows[field] += [x.copy() for x in part] if field in lists else part
    if name is not None:
        yield name, rows


def overlaps(sets: list[np.ndarray], of: np.ndarray | None = None, width: int = 2048) -> np.ndarray:
    """How many values each two of the sets, or those numbered ``of`` and all, share, as whole numbers in
    single precision: the matrix is as large as the cell squared, and no copy of it is made."""
    count = len(sets)
    of = np.arange(count) if of is None else of
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    values, place, often = np.unique(
        np.concatenate(sets) if count else np.empty(0), return_inverse=True, return_counts=True
    )
    number = np.cumsum(often > 1) - 1
    keep = often[place] > 1
    owner, place = owner[keep], number[place[keep]]
    out = np.zeros((len(of), count), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for begin in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        low, high = np.searchsorted(place, [begin, begin + width])
        x = np.zeros((count, width), dtype=np.float32)
        x[owner[low:high], place[low:high] - begin] = 1
        out += (x if len(of) == count else x[of]) @ x.T
    return out

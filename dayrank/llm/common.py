"""What the corpus operators share: reading, running Python on Arrow batches, byte texts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python function at once; long texts make batches smaller, see ``slices``.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


#: Rows and bytes that Spark hands to Python at once. Texts are long, and an executor holds a
#: batch on its way in and on its way out for each task.
ARROW_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20,
}


#: Python workers live on from task to task; these make them give freed memory back to the system.
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_MMAP_THRESHOLD_": str(1 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(1 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers on machines that see this folder import the package, wherever the
    driver was started. On other clusters it is installed or sent with --py-files. Keep Arrow
    batches small; that changes no result."""
    for key, most in ARROW_BATCHES.items():
        spark.conf.set(key, most)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    env.update(WORKER_MEMORY)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def slices(
    batches: Iterator[pa.RecordBatch], text: str, size: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none holds many more than so many bytes of the text column."""
    for batch in batches:
        width = max(1, batch.column(batch.schema.get_field_index(text)).nbytes // max(1, batch.num_rows))
        step = max(1, min(BATCH_ROWS, size // width))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(values: pa.Array) -> list[bytes]:
    """The bytes of a text column; null is empty."""
    if pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary())
    elif pa.types.is_string(values.type):
        values = values.cast(pa.binary())
    return [v if v is not None else b"" for v in values.to_pylist()]


def map_arrow(
    df: DataFrame,
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    ready(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def lookup(df: DataFrame, rows: int) -> DataFrame:
    """The frame, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if small_enough(df, rows) else df


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]

"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings the plans are laid out for. None of them changes a result.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods beyond 8000 bytes of bytecode. A 96-column projection
    # fused into one method runs ten times slower than the same one left unfused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
#: Intermediate tables written since the innermost ``temporary_tables`` began: paths, and names in the
#: catalogue.
_written: list[list[str]] = []
_named: list[list[str]] = []


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: what the cluster names in spark.checkpoint.dir, or
    where that is unset, a folder in the session's warehouse if that is a shared one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/dayrank-intermediate"
        require_shared(folder, spark.sparkContext.master)
    folder = folder.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def require_shared(folder: str, master: str) -> None:
    """A folder of the driver's machine is no shared one on a cluster: executors would each write to
    their own."""
    if not master.startswith("local") and (folder.startswith("file:") or "://" not in folder):
        raise ValueError(f"set spark.checkpoint.dir to a folder all executors reach; {folder} is local to a machine")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that a lost executor costs
    a re-read and not the whole lineage, and so that several readers share the work. With
    ``partition_by`` readers that filter on that column open only its files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _written:
        _written[-1].append(path)
    if partition_by:
        # A value's rows are gathered into files of the advisory size, large values into several.
        df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_table(name: str, path: str) -> None:
    """Let the innermost ``temporary_tables`` remove a table of the catalogue and its files."""
    if _written:
        _written[-1].append(path)
        _named[-1].append(name)


def remove(spark: SparkSession, name: str) -> None:
    """Delete a path, if there is one, through the file system it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))


def file_names(spark: SparkSession, name: str) -> set[str]:
    """The names in a folder, none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {found.getPath().getName() for found in files.listStatus(path)} if files.exists(path) else set()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``materialize`` writes inside the block when it ends. For a job that
    has written its output by then; a frame read from them is of no use afterwards."""
    _written.append([])
    _named.append([])
    try:
        yield
    finally:
        for name in _named.pop():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for name in _written.pop():
            remove(spark, name)

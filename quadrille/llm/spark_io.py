"""What the operators share of Spark: sizes, columns, and tables that cut lineage."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and all runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: this cuts the lineage,
    and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quadrille/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files whose readers are done go when the driver next collects its garbage: let it do so now.
    To be called where nothing refers to what was written any more."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    for _ in range(2):  # what Python lets go of first is let go of by the other side in the second round
        gc.collect()
        if jvm is not None:
            jvm.System.gc()
        time.sleep(0.3)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables below df, as planned: nothing runs for it. What has no known size counts as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def partitions(df: DataFrame) -> int:
    """Partitions for what is as large as the input: one for each scan split, and no fewer than for any shuffle."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-input_bytes(df) // split_bytes(spark)), 1 << 20))


def split_bytes(spark: SparkSession) -> int:
    """The most that a scan partition holds."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(size[:-1]) * units[size[-1]] if size[-1] in units else int(size)


def _c_library(name: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def frugal(rows):
    """For a function of Arrow batches: when its task ends, the worker, which serves many tasks, returns what it freed."""

    @functools.wraps(rows)
    def run(batches):
        _c_library("mallopt", -3, 1 << 22)  # arrays over 4 MB are mapped and go back when freed
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _c_library("malloc_trim", 0)

    return run


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts and blobs can be long: tasks get them a thousand or BATCH_BYTES at a time, unless the session asks for fewer rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        spark.conf.set(key, BATCH_BYTES)

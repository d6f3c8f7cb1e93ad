"""Tables kept in the folder that the whole cluster shares, where a plan must be cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from maxentnet.plans import files

#: Spark's setting that ends the shuffle files of a job with the job.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LEFT: dict[str, SparkSession] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, removed at the end of the process. Where that is unset, a temporary one if the executors run on this machine; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = kept.get() if kept.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        base = "file://" + tempfile.mkdtemp(prefix="maxentnet-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_clear)
    _LEFT[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _LEFT.pop(path, None)


def _clear() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            delete(spark, path)
        except Exception:  # the session has ended
            return


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs inside drop their shuffle files as they end: what they wrote is read again, they are not."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame from a table: computed once, read by every later job, lost with no executor."""
    spark = df.sparkSession
    path = folder(spark, name)
    with freed_shuffles(spark):
        df.write.options(**files.options(spark, path)).parquet(path)
    _trimmed(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _trimmed(spark: SparkSession) -> None:
    """Loops leave many plans behind: a driver's heap that is more than half full of them gives its memory back."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * (heap.totalMemory() - heap.freeMemory()) > heap.maxMemory():
        spark._jvm.java.lang.System.gc()


def forget(*frames: DataFrame) -> None:
    """Deletes the tables of frames that ``written`` gave, which nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df.written_at)


def exists(df: DataFrame) -> bool:
    """Whether the table of a frame that ``written`` gave is still there."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(where)


def kept(df: DataFrame) -> DataFrame:
    """For ``transform``: what several later plans read is written once. Their plans then begin at a scan, where cached frames would nest."""
    return written(df, "kept")

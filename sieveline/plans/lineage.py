"""Cutting lineage so that lost executors cost a re-read instead of a recomputation."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that an execution's shuffle files go at its end; versions before 4.1 don't know it and leave them to the cleaner.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where the session names none, a folder of our own in local mode, as in tests,
    and an error on a cluster, whose executors don't share a local folder."""
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="sieveline_checkpoint_")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(f"file://{own}")
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, computed once now and stored reliably."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """The same rows, written as a Parquet table in the shared folder and read back: smaller than a checkpoint for long
    texts."""
    path = f"{checkpoint_dir(frame.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the table of a frame as `stored` gave it, when what was made from it is stored itself."""
    spark = table.sparkSession
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete what nothing refers to any more: shuffle files and, where the session allows it,
    checkpoints. It follows the driver's garbage, which a driver with little to do doesn't collect for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Each execution of frames made within it deletes its shuffle files at its end. The cleaner alone keeps those of the last
    execution at least, even after `release`, so they stood beside those of the next."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)

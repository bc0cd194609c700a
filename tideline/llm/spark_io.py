"""Cutting lineage in the folder that the cluster shares, and joins whose small side is checked."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys that a join may send to every worker; with more, both sides are shuffled.
SENT_ROWS = 1 << 18
#: Spark's setting by which a query's shuffle files go when it ends, and not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there: later steps neither repeat its work nor need the
    executors that did it, and its shuffle files go. The folder is spark.checkpoint.dir. One of our own serves only on a
    local master, where driver and tasks share it; elsewhere an unset folder is an error."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own: df may have shuffles that others read
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, set as the session's own where that was not done yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tideline-"))
    return sc.getCheckpointDir()


@dataclass
class Folder:
    """Tables written below one path of the shared folder, for steps that read few of their columns again."""

    spark: SparkSession
    path: str

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that later steps read; nothing of what made it is run again."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Takes a table, or all of them, away once no later step reads it."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shared_folder(spark: SparkSession) -> Iterator[Folder]:
    """A new folder for tables; what is in it goes if the work fails."""
    folder = Folder(spark, f"{checkpoint_folder(spark)}/{uuid.uuid4()}")
    try:
        yield folder
    except BaseException:
        folder.drop()
        raise


def sendable(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """df marked to be sent to every worker if it is checked to have at most `rows` rows (of bounded width); else as it is,
    to be joined by shuffling. df should be cheap to count: written down or small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with the worker's free memory given back at the end of each task: a worker that has been through one large batch
    would keep it while other stages run beside it."""

    def and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return and_back

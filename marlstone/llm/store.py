"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marlstone.session import shared_dir
from marlstone.workers import ship

class Scratch:
    """Tables written while an operator runs; drop() removes them.

    A written table cuts lineage: a lost executor costs a reread, never a recomputation, and what
    was written is the same for every later reader even if its producer is not deterministic.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.written = 0

    def path(self, name: str) -> str:
        self.written += 1
        self.paths.append(f"{self.root}/{self.written}-{name}")
        return self.paths[-1]

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: tuple[str, ...] = ()) -> None:
        """Remove the tables, but for those by these names, and free the shuffle files of frames that are gone.

        Spark removes shuffle files when the driver collects the objects that stand for them, which
        a driver with room to spare may not do for hours.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in [p for p in self.paths if p.rsplit("/", 1)[1].split("-", 1)[1] not in keep]:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
            self.paths.remove(p)
        gc.collect()
        jvm.System.gc()


def _release() -> None:
    """Give memory that is free back to the system: workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def map_batches(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow with the package at hand in the workers; what a task has held is free when it ends."""
    ship(df.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(released, schema)

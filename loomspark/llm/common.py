"""Shared helpers: scratch tables in the cluster's shared folder, skew-proof joins, column hygiene."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.skew import hot_split_join  # noqa: F401
from loomspark.sources.scratch import shared_root

NULL_ID = -(2**63)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most `rows` rows for this session, unless it has set its own: whole texts make long rows, and JVM and
    Python each hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Free heap pages to the system; a Python worker lives on after its batch."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def give_back_memory() -> None:
    """The same after a large task, with what Python itself still holds."""
    gc.collect()
    trim()


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}
        self.made = 0

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}-{self.made}"
        self.made += 1
        df.write.options(**options).parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove the named tables (all, if none is named); only after their last reader has run."""
        for n in names or list(self.paths):
            for path in self.paths.pop(n, []):
                delete_path(self.spark, path)


def keyed(df: DataFrame, id_col: str, key: str = "__id") -> DataFrame:
    """With a non-null join key: a null id becomes the smallest long."""
    return df.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)))


def text_bytes(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")).cast("binary")

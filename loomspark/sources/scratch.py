"""Written steps for iterative operators: the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a temporary folder that goes at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="loomspark-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def cutter(spark: SparkSession, tag: str, **options: str):
    """cut(df, step): df written to the shared folder and read back, which cuts its lineage and survives lost executors. options are the writer's."""
    root = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"

    def cut(df: DataFrame, step: int | str) -> DataFrame:
        path = f"{root}/{step}"
        df.write.options(**options).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return cut

"""Every registered query of the engine with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.plans import attention_plans, dual_plans, graph_plans, loop_plans, more_plans, synthesis_plans, text_plans  # noqa: F401
from loomspark.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["tree_segments"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

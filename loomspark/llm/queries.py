"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import importance, licenses, line_dedup, media, mixing, near_dedup, packing, periodic_runs, quality, suffix_dedup, token_output, topk, toxicity

_MODULES = {
    "op1_line_dedup": line_dedup,
    "op2_near_dedup": near_dedup,
    "op3_licenses": licenses,
    "op4_topk": topk,
    "op5_token_output": token_output,
    "op6_packing": packing,
    "op7_quality": quality,
    "op8_mixing": mixing,
    "op9_toxicity": toxicity,
    "op10_media": media,
    "op11_periodic_runs": periodic_runs,
    "op12_suffix_dedup": suffix_dedup,
    "op13_importance": importance,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}

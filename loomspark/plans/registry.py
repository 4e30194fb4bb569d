"""Queries by name, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TAPES = r"""
T AS (SELECT conv_id AS doc_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
L AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
H AS (
  SELECT page_id AS doc_id,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?s)<(script|style|head|nav|footer)[^>]*>.*?</(script|style|head|nav|footer)>', '', 'g'),
      '(?s)<!--.*?-->', '', 'g'),
      '<h1[^>]*>', chr(10) || chr(10) || '# ', 'g'),
      '</h1>', chr(10) || chr(10), 'g'),
      '<p[^>]*>', chr(10) || chr(10), 'g'),
      '<br[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS text
  FROM pages)"""


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; sql may use the tapes T, L and H, to which it adds after WITH."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.replace("WITH TAPES", "WITH RECURSIVE " + TAPES.strip())
        return f

    return add

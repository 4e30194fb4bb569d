"""Line dedup: drop long lines that many documents share, keep each in one document.

Lines are normalised and hashed where the text lies; only (hash, document) pairs are shuffled. The texts move
once, to meet the hashes that their document loses.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, hot_split_join, keyed, text_bytes, trim

WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(WHITE).lower()


def is_long(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars


def _hashes_udf(min_chars: int):
    @F.arrow_udf("array<binary>")
    def line_hashes(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            keys = {k for k in map(line_key, t.as_py().split(b"\n")) if is_long(k, min_chars)}
            out.append([xxhash.xxh3_128_digest(k) for k in keys])
        hashes = pa.array(out, pa.list_(pa.binary()))
        del out
        trim()
        return hashes

    return line_hashes


def _rebuild_udf(min_chars: int):
    @F.arrow_udf("struct<text:string,n_lines:long,n_dropped:long>")
    def rebuild(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, total, lost = [], [], []
        for t, d in zip(texts, drops):
            text, d = t.as_py(), d.as_py()
            n = text.count(b"\n") + 1
            gone = 0
            if d:
                d, stay = set(d), []
                for line in text.split(b"\n"):
                    k = line_key(line)
                    if is_long(k, min_chars) and xxhash.xxh3_128_digest(k) in d:
                        gone += 1
                    else:
                        stay.append(line)
                text = b"\n".join(stay)
            kept.append(text)
            total.append(n)
            lost.append(gone)
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        del kept
        trim()
        return pa.StructArray.from_arrays([texts, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], ["text", "n_lines", "n_dropped"])

    return rebuild


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, the text without its dropped lines, plus n_lines and n_dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least min_chars code
    points found in at least min_docs documents lose all their lines, except in the largest id that holds them.

    Null or empty text: one empty line, which stays; the result is the empty text. A null id counts as one
    document, smaller than all others. Rows that repeat an id are one document for the count and each keep or
    lose their own lines. A column named n_lines or n_dropped is replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    docs = keyed(docs, id_col)
    hashes = _hashes_udf(min_chars)
    keys = scratch.write(docs.select("__id", F.explode(hashes(text_bytes(text_col))).alias("__h")), "keys")
    shared = (
        keys.groupBy("__h", "__id").agg(F.count("*").alias("__n"))
        .groupBy("__h").agg(F.sum("__n").alias("__rows"), F.count("*").alias("__docs"), F.max("__id").alias("__keep"))
        .filter(F.col("__docs") >= min_docs).drop("__docs")
    )
    shared = scratch.write(shared, "shared")
    hits = hot_split_join(keys, shared, "__h", "__rows").filter(F.col("__id") != F.col("__keep"))
    drops = scratch.write(hits.groupBy("__id").agg(F.collect_set("__h").alias("__drops")), "drops")
    scratch.drop("keys", "shared")
    rebuild = _rebuild_udf(min_chars)
    out = docs.join(drops.hint("merge"), "__id", "left").withColumn("__new", rebuild(text_bytes(text_col), F.col("__drops")))
    names = [c for c in docs.columns if c not in ("__id", "n_lines", "n_dropped")]
    return out.select(*[F.col("__new.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names], "__new.n_lines", "__new.n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keep FROM keys WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (s.key IS NOT NULL AND k.doc_id <> s.keep) AS gone
  FROM keys k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

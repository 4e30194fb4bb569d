"""Token-ID output: documents as Parquet lists of token ids, in id order, with a cheap index over them.

File format (one table, files in ascending id order):
  part int       number of the file; constant in it
  row long       place in the file, from 0
  <id> long      the document's id
  n_tokens long  length of ids, so that offsets are read without the tokens
  ids array<int> the token ids, with the end id

Ids are dictionary-encoded to the bits that the vocabulary needs (values beyond the dictionary's page fall back to
delta encoding under writer version 2), row groups have a set size, and page indexes let a reader skip to single documents.
"""

from __future__ import annotations

import sys
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomspark.llm.common import Scratch, small_batches, text_bytes
from loomspark.llm.tokens import codec, vocabulary


def token_ids_udf(path: str, kind: str, end_id: int | None):
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    @F.arrow_udf("array<int>")
    def token_ids(texts: pa.Array) -> pa.Array:
        c = codec(path, kind)
        parts = [c.ids(t.as_py()) + end for t in texts]
        offsets = [0]
        for p in parts:
            offsets.append(offsets[-1] + len(p) // 4)
        values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(parts))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return token_ids


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    assert sys.byteorder == "little"
    values = memoryview(ids.values.to_numpy(zero_copy_only=True)).cast("B")
    at = ids.offsets.to_pylist()
    return pa.array([zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.int64())


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int | None = None, row_group_bytes: int = 16 << 20, page_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the format above to path, in ascending id order.

    Null or empty text: only the end id. Null ids come first. Rows that repeat an id each get their own list, in the
    order of their texts' hashes. Only id_col and text_col are read; other columns, whatever their names, stay out.
    An empty table gives files without rows.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias(id_col), text_bytes(text_col).alias("__text"))
    ordered = named.withColumn("__tie", F.xxhash64("__text"))
    ordered = ordered.repartitionByRange(F.col(id_col), F.col("__tie")).sortWithinPartitions(id_col, "__tie")
    ids = token_ids_udf(tokenizer, kind, end_id)(F.col("__text"))
    out = ordered.select(
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"),
        F.col(id_col),
        ids.alias("ids"),
    )
    out = out.select("part", "row", id_col, F.size("ids").cast("long").alias("n_tokens"), "ids")
    out.write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true",
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.row.count.limit": str(page_rows),
        }
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The written table. Columns that aren't asked for aren't read."""
    return spark.read.schema(f"part int, row long, `{id_col}` long, n_tokens long, ids array<int>").parquet(path)


def read_documents(spark: SparkSession, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """The rows of some ids. The condition reaches the scan: files and row groups are left out by their statistics, and of the others only the
    pages that may hold an id are read, since rows are in id order. Up to ten ids are looked up one by one, more as the range that they span.
    """
    return read_tokens(spark, path, id_col).filter(F.col(id_col).isin([int(i) for i in ids]))


def with_starts(tokens: DataFrame) -> DataFrame:
    """tokens plus start: the ids of all documents before each.

    The sums of the files come from the n_tokens column alone, and are as many as there are files; the rest is a
    running sum in each file.
    """
    per_file = tokens.groupBy("part").agg(F.sum("n_tokens").alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_file.select("part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return tokens.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(offsets), "part").withColumn("start", F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{Scratch(spark, 'tokens').root}/ids"
    write_tokens(docs, path, vocabulary("word_bpe_49k.json"), "words", end_id=2)
    tokens = read_tokens(spark, path)
    back = tokens.select("part", "row", "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"))
    return with_starts(back).select("doc_id", "start", "n_tokens", "ids_crc32")

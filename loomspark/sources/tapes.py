"""Sources: tables and the tapes (one text a row) made from them, plus whole files, notebooks and headerless CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import BREAK, ordered_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: path, text."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def files_or_literal(spark: SparkSession, path: str, fallback: str) -> DataFrame:
    """The files, or one row with the fallback text where there are none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return whole_files(spark, path)
    return spark.createDataFrame([(path, fallback)], "path string, text string")


def csv_without_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Matrices, vectors or edges; compressed files too."""
    return spark.read.schema(schema).option("header", "false").csv(path)


def notebook_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, cell (from 0), kind, source of each notebook cell."""
    cells = F.from_json("text", "cells array<struct<cell_type:string,source:array<string>>>")
    rows = whole_files(spark, path).select("path", F.posexplode(cells["cells"]).alias("cell", "c"))
    return rows.select("path", "cell", F.col("c.cell_type").alias("kind"), F.array_join("c.source", "").alias("source"))


def listed_pieces(rows: DataFrame, id_col: str, pieces_col: str) -> DataFrame:
    """Input that is a list already passes through: id, win_idx, text."""
    return rows.select(F.col(id_col), F.posexplode(pieces_col).alias("win_idx", "text"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the turns of a conversation as "role: text" paragraphs."""
    turn = F.concat("role", F.lit(": "), "text")
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(ordered_join(["turn"], turn, BREAK).alias("text"))


def spaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: each line a paragraph."""
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(BREAK)).alias("text"))


MARKDOWN_STEPS = [
    (r"(?s)<(script|style|head|nav|footer)[^>]*>.*?</(script|style|head|nav|footer)>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"<h1[^>]*>", "\n\n# "),
    (r"</h1>", "\n\n"),
    (r"<p[^>]*>", "\n\n"),
    (r"<br[^>]*>", "\n"),
    (r"<[^>]*>", ""),
]


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a page's headings and paragraphs as markdown."""
    text = F.col("html")
    for pattern, to in MARKDOWN_STEPS:
        text = F.regexp_replace(text, pattern, to)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), text.alias("text"))


WINDOW, HEADS, LAYERS = 32, 2, 2


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attn(window_idx, layer, head, i, j, w) from the embeddings: a window is WINDOW consecutive vectors, a head one half of
    the dimensions, and layer k scales scores by 4 (k + 1); w is the softmax over j, to 6 decimals."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / WINDOW).alias("window_idx"), (F.col("vec_id") % WINDOW).cast("int").alias("i"), "embedding")
    half = F.size("embedding") / HEADS
    parts = v.select("window_idx", "i", F.explode(F.sequence(F.lit(0), F.lit(HEADS - 1))).alias("head"), "embedding")
    parts = parts.select("window_idx", "head", "i", F.slice("embedding", (F.col("head") * half + 1).cast("int"), half.cast("int")).alias("e"))
    other = parts.select("window_idx", "head", F.col("i").alias("j"), F.col("e").alias("f"))
    dots = F.aggregate(F.zip_with("e", "f", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = parts.join(other, ["window_idx", "head"]).select("window_idx", "head", "i", "j", F.round(dots, 6).alias("d"))
    scaled = pairs.select("window_idx", F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1))).alias("layer"), "head", "i", "j", "d")
    scaled = scaled.withColumn("x", F.exp(F.col("d") * 4 * (F.col("layer") + 1)))
    rows = scaled.groupBy("window_idx", "layer", "head", "i").agg(F.sum("x").alias("total"), F.collect_list(F.struct("j", "x")).alias("cells"))
    return rows.select("window_idx", "layer", "head", "i", F.explode("cells").alias("c"), "total").select("window_idx", "layer", "head", "i", F.col("c.j").alias("j"), F.round(F.col("c.x") / F.col("total"), 6).alias("w"))

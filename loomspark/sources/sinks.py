"""Sinks: JSON results, node-link graphs, summaries, markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.dedup import deduplicate_markdown
from loomspark.operators.graph import connected_components


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.mode("overwrite").text(path)


def node_link(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, json: {"nodes": [...], "links": [...]} of each graph, sorted by id."""
    n = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "tag", F.length("content").alias("content_length")))).alias("nodes"))
    e = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce("weight", F.lit(1.0)).alias("weight")))).alias("links"))
    rows = n.join(e, "doc_id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<source:string,target:string,weight:double>>")))
    return rows.select("doc_id", F.to_json(F.struct("nodes", "links")).alias("json"))


def graph_summary(segments: DataFrame, edges: DataFrame, names: DataFrame, cut) -> DataFrame:
    """doc_id, segments, edges, tags and edge_types (arrays of name and n, by name), connected: all segments are in one component of the edges.

    names: edge_type, name; a missing type is 0. cut writes the steps of the components. A document without segments has no row.
    """
    tags = segments.groupBy("doc_id", "tag").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.sum("c").alias("segments"), F.array_sort(F.collect_list(F.struct(F.col("tag").alias("name"), F.col("c").alias("n")))).alias("tags"))
    typed = edges.withColumn("edge_type", F.coalesce("edge_type", F.lit(0)).cast("int")).join(F.broadcast(names.select("edge_type", "name")), "edge_type", "left")
    e = typed.groupBy("doc_id", "name").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("edges"), F.array_sort(F.collect_list(F.struct("name", "n"))).alias("edge_types"))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))  # its length first, so that no two pairs make one key
    key = lambda c: F.concat(F.when(F.col("doc_id").isNull(), F.lit("-")).otherwise(F.length(doc).cast("string")), F.lit(":"), doc, F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")))
    comps = connected_components(segments.select(key("id").alias("id")), edges.select(key("src").alias("src"), key("dst").alias("dst")), cut)
    parts = segments.select("doc_id", key("id").alias("id")).distinct().join(comps, "id").groupBy(F.col("doc_id").alias("__d")).agg(F.count_distinct("comp").alias("__parts"))
    rows = tags.join(e, "doc_id", "left").na.fill(0, ["edges"])
    rows = rows.join(parts, rows["doc_id"].eqNullSafe(parts["__d"]))
    none = F.array().cast("array<struct<name:string,n:bigint>>")
    return rows.select("doc_id", "segments", "edges", "tags", F.coalesce("edge_types", none).alias("edge_types"), (F.col("__parts") == 1).alias("connected"))


def write_deduplicated(docs: DataFrame, folder: str) -> None:
    """A markdown file for each document (doc_id, text) without its repeated sections: folder/<doc_id>_deduplicated/part-*. Each id is a folder of its own."""
    out = deduplicate_markdown(docs).select(F.concat(F.col("doc_id").cast("string"), F.lit("_deduplicated")).alias("name"), "text")
    out.write.mode("overwrite").partitionBy("name").text(folder)

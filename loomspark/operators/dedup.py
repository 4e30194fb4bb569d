"""Markdown deduplication within a document: sections by normalised content, code blocks by their code.

A null or empty text has no sections and becomes the empty text; ties go to the first in order; ids should be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import strip, words
from loomspark.operators.segment import sections

# fixed values
FILLERS = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
FENCE = r"```[\s\S]*?```"


def normalized(c: Column) -> Column:
    """Without headers, markup, fillers and words of up to two characters; fenced blocks stand as a word in place and as numbered marks at the end."""
    bare = F.regexp_replace(c, r"(?mdU)^#{1,6}\s+.+$", "")
    blocks = F.size(F.regexp_extract_all(bare, F.lit(f"({FENCE})")))
    text = F.regexp_replace(F.regexp_replace(bare, FENCE, "<CODE_BLOCK>"), r"[*_`#\[\]()]", "")
    kept = F.filter(words(F.lower(text)), lambda w: ~w.isin(FILLERS) & (F.length(w) > 2))
    marks = F.when(blocks > 0, F.transform(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))), lambda i: F.concat(F.lit("CODE_BLOCK_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(kept, marks), " ")


def signature(c: Column) -> Column:
    return F.md5(normalized(c).cast("binary"))


def code_signature(c: Column) -> Column:
    """Of a fenced block: fences, # comments and white space don't matter."""
    code = F.regexp_replace(F.regexp_replace(c, r"(?md)^```.*$", ""), r"(?md)#.*$", "")
    return F.md5(strip(F.regexp_replace(code, r"(?U)\s+", " ")).cast("binary"))


def unique_sections(found: DataFrame) -> DataFrame:
    """The first section of each signature in its document. Sections with only a header share the empty signature."""
    first = F.row_number().over(Window.partitionBy("doc_id", "sig").orderBy("ord"))
    return found.withColumn("sig", signature(F.col("content"))).withColumn("__k", first).filter("__k = 1").drop("__k", "sig")


def unique_code(found: DataFrame) -> DataFrame:
    """Sections without the code blocks whose signature an earlier block of the document has; a repeat of a block kept in the same section stays.

    A section's text is cut at its blocks, judged block by block, and joined again.
    """
    cut = found.select("doc_id", "ord", "level", "title", "start_line", F.regexp_extract_all("content", F.lit(f"({FENCE})")).alias("blocks"), F.split(F.regexp_replace("content", FENCE, "\u0001"), "\u0001", -1).alias("rest"))
    blocks = cut.select("doc_id", "ord", F.posexplode("blocks").alias("k", "block")).withColumn("sig", code_signature(F.col("block")))
    first = F.row_number().over(Window.partitionBy("doc_id", "sig").orderBy("ord", "k")) == 1
    judged = blocks.withColumn("first", first)
    judged = judged.withColumn("keep", F.max(F.when(F.col("first"), 1).otherwise(0)).over(Window.partitionBy("doc_id", "ord", "block")) == 1)
    kept = judged.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("keep"), F.col("block")).otherwise("").alias("b")))).alias("js"))
    rows = cut.join(kept, ["doc_id", "ord"], "left")
    pieces = F.zip_with("rest", F.coalesce("js", F.array().cast("array<struct<k:int,b:string>>")), lambda r, j: F.concat(F.coalesce(r, F.lit("")), F.coalesce(j["b"], F.lit(""))))
    return rows.select("doc_id", "ord", "level", "title", F.regexp_replace(F.array_join(pieces, ""), r"\n{3,}", "\n\n").alias("content"), "start_line")


def reassembled(found: DataFrame) -> DataFrame:
    """doc_id, text: stripped sections in order, a blank line before each that doesn't begin with a header (not before the first)."""
    body = strip(F.col("content"))
    order = Window.partitionBy("doc_id").orderBy("ord")
    rows = found.withColumn("k", F.row_number().over(order)).withColumn("part", F.when((F.col("k") > 1) & ~body.startswith("#"), F.concat(F.lit("\n"), body)).otherwise(body))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda r: r["part"]), "\n")
    return rows.groupBy("doc_id").agg(strip(F.regexp_replace(text, r"\n{4,}", "\n\n\n")).alias("text"))


def deduplicate_markdown(docs: DataFrame) -> DataFrame:
    """doc_id, text, duplicates (sections gone), compression (length over that before; 1 of an empty text)."""
    found = sections(docs)
    kept = unique_sections(found)
    counts = found.groupBy("doc_id").agg(F.count("*").alias("a")).join(kept.groupBy("doc_id").agg(F.count("*").alias("b")), "doc_id")
    out = docs.select("doc_id", F.length("text").alias("n")).join(reassembled(unique_code(kept)), "doc_id", "left").join(counts, "doc_id", "left")
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("a") - F.col("b"), F.lit(0)).alias("duplicates"), F.when(F.col("n") > 0, F.length(F.coalesce("text", F.lit(""))) / F.col("n")).otherwise(1.0).alias("compression"))

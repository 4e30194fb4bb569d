"""Pluggable models with deterministic stand-ins: embedding, relation classification, generation; segmenters as table functions."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loomspark.functions.text import words
from loomspark.operators.segment import Segmenter

RELATIONS = ["explains", "elaborates", "contradicts", "is_example_of", "is_consequence_of", "depends_on", "no_relation"]


def hashed_embedding(c: Column, dim: int = 64) -> Column:
    """Stand-in for a text model: counts of hashed words, scaled to length one (zeros for a blank text)."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        rows = np.zeros((len(texts), dim))
        for k, t in enumerate(texts.to_pylist()):
            at = [zlib.crc32(w.encode()) % dim for w in (t or "").lower().split()]
            if at:
                rows[k] = np.bincount(at, minlength=dim)
                rows[k] /= np.linalg.norm(rows[k])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, dim), pa.int32()), pa.array(rows.ravel()))

    return run(c)


def classify_pairs(pairs: DataFrame, model: Callable[[list[str], list[str]], list[str]] | None = None, most: int = 1000) -> DataFrame:
    """pairs (a_text, b_text) plus relation. Texts go to the model cut at `most` characters; an answer that isn't a known relation is "unknown", as is
    every pair with a null text, which the model doesn't see. Without a model all pairs are "no_relation"."""
    if model is None:
        return pairs.withColumn("relation", F.lit("no_relation"))

    @F.arrow_udf("string")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = [(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())]
        told = [x is not None and y is not None for x, y in pairs]
        asked = [p for p, t in zip(pairs, told) if t]
        found = iter(model([x[:most] for x, _ in asked], [y[:most] for _, y in asked]) if asked else [])
        answers = [next(found) if t else None for t in told]
        return pa.array([x if x in RELATIONS else "unknown" for x in answers], pa.string())

    return pairs.withColumn("relation", run("a_text", "b_text"))


def generate(prompts: DataFrame, model: Callable[[list[str]], list[str]] | None = None, most_words: int = 64) -> DataFrame:
    """prompts (prompt) plus answer; the stand-in repeats the prompt's first words."""
    if model is None:
        return prompts.withColumn("answer", F.array_join(F.slice(words(F.col("prompt")), 1, most_words), " "))

    @F.arrow_udf("string")
    def run(p: pa.Array) -> pa.Array:
        return pa.array(model(p.to_pylist()), pa.string())

    return prompts.withColumn("answer", run("prompt"))


def segments_table(docs: DataFrame, segmenter: Segmenter) -> DataFrame:
    """A segmenter as a table function: doc_id, ord, content."""
    return docs.select("doc_id", F.posexplode(segmenter(F.col("text"))).alias("ord", "content"))


def python_segmenter(f: Callable[[str], list[str]]) -> Segmenter:
    """A plain function from text to pieces as a segmenter over Arrow batches."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([f(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    return run


def table_function(spark: SparkSession, name: str, f: Callable[[str], list[str]]) -> None:
    """Makes f, from text to pieces, a table function for SQL: name(text) gives ord and content, for LATERAL joins. A null text has no pieces."""

    class Segments:
        def eval(self, text: str):
            yield from enumerate(f(text) if text is not None else [])

    spark.udtf.register(name, udtf(Segments, returnType="ord: long, content: string"))


def partition_function(spark: SparkSession, name: str, f: Callable[[str], list[str]], id_col: str, order_col: str, text_col: str) -> None:
    """The same for a partitioned table: name(TABLE(t) PARTITION BY id ORDER BY place) cuts the rows of an id one after the other and numbers their pieces on: the id (as
    key), at (the row's place), ord and content. What is held is a count; null texts have no pieces."""

    class Segments:
        def __init__(self):
            self.made = 0

        def eval(self, row):
            for piece in f(row[text_col]) if row[text_col] is not None else []:
                yield row[id_col], row[order_col], self.made, piece
                self.made += 1

    spark.udtf.register(name, udtf(Segments, returnType="key: long, at: long, ord: long, content: string"))

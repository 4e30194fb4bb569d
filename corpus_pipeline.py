"""The corpus pipeline: from documents to packed training sequences in five stages.

quality      documents that the classifier rejects go
line_dedup   lines that many documents share stay in one of them
near_dedup   one document of each group of near duplicates stays
mixing       documents are taken as often, or as far, as their source's target asks
packing      token pieces placed in sequences of at most 2048 tokens

Each stage works on all that the one before has kept; all but the last return the columns of documents, whatever other columns their input has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch
from loomspark.llm.learning import held_out
from loomspark.llm.line_dedup import line_dedup
from loomspark.llm.mixing import mix_documents
from loomspark.llm.near_dedup import drop_near_duplicates
from loomspark.llm.packing import packed_documents
from loomspark.llm.quality import score_quality, train_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least .5, learnt from the labels that op7's folds allow. Null and empty texts are scored as empty; a null id isn't learnt
    from but scored; rows that repeat an id or a text are scored each, alike. Without labels every score is .5 and all stay. An empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_quality(docs, labels, ~held_out("doc_id", 3, 1))
    return score_quality(docs, model, score_col="__quality").filter(F.col("__quality") >= 0.5).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their lines of 40 code points or more that five documents share, but in the largest id that holds them. Null texts become empty;
    rows that repeat an id are one document for the count; n_chars is that of the new text."""
    return _columns(line_dedup(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near duplicates, one row of it (ties by the text's hash). Null, empty and blank texts have no duplicates: they all
    stay, once for each id. A null id is the smallest."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in the mix's order, its text cut to the words taken, so ids repeat from here on. Texts without
    words give nothing; a null source is a source of its own; rows that repeat an id are taken each."""
    return mix_documents(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece with its place in a sequence. Null and empty texts are the end id alone; rows that repeat an id give pieces each."""
    return packed_documents(docs)


STAGES = [("quality", quality), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None  # a trained classifier and a tokenizer have no SQL; tests/llm/test_pipeline.py compares each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents. Each stage's result is written to the shared folder and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)

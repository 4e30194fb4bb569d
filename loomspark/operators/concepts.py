"""How concepts move through conversations: threads of mentions, and what became of each concept in each conversation.

A concept is a word of at least `least` letters, lower-cased; other sources of concepts can give the same columns: mentions (conv_id, turn, concept), each once. Null texts mention
nothing. Every step groups by conversation and concept, so a common word of many conversations is never held together but in counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import has_code, jaccard, word_set


def mentions_of(turns: DataFrame, least: int = 6) -> DataFrame:
    """conv_id, turn, concept of turns (conv_id, turn, text)."""
    return _said(turns, least).distinct()


def _said(turns: DataFrame, least: int = 6) -> DataFrame:
    """mentions_of, where a repeated turn's come again."""
    found = F.filter(word_set(F.col("text")), lambda w: F.length(w) >= least)
    return turns.select("conv_id", "turn", F.explode(found).alias("concept"))


def evolution(turns: DataFrame, gap: int = 2, alike: float = 0.2, mentions: DataFrame | None = None) -> DataFrame:
    """conv_id, concept, thread (from 0), first, last, mentions, changed: mentions at most `gap` turns apart are a thread; it has changed if what the first and
    the last turn of the thread say is less alike than `alike` (Jaccard of their words)."""
    order = Window.partitionBy("conv_id", "concept").orderBy("turn")
    if mentions is None:  # repeated ones go where threads are made, without a shuffle of their own
        mentions = _said(turns).withColumns({"k": F.row_number().over(order), "same": F.lag("turn").over(order).eqNullSafe(F.col("turn"))}).filter("k = 1 OR NOT same").drop("k", "same")
    new = F.coalesce((F.col("turn") - F.lag("turn").over(order) > gap).cast("int"), F.lit(0))
    rows = mentions.withColumn("new", new).withColumn("thread", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    threads = rows.groupBy("conv_id", "concept", "thread").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("mentions"))
    # two turns are compared once, however many threads they begin and end, so words don't travel with threads
    words = turns.select("conv_id", "turn", word_set(F.col("text")).alias("w"))
    a, b = (words.select("conv_id", F.col("turn").alias(c), F.col("w").alias(f"w_{c}")) for c in ("first", "last"))
    ends = threads.select("conv_id", "first", "last").distinct().join(a, ["conv_id", "first"]).join(b, ["conv_id", "last"])
    told = ends.select("conv_id", "first", "last", (F.round(jaccard(F.col("w_first"), F.col("w_last")), 9) < alike).alias("changed"))
    return threads.join(told, ["conv_id", "first", "last"]).select("conv_id", "concept", "thread", "first", "last", "mentions", "changed")


# what becomes of a concept, in the order in which the conditions are tried
KINDS = ("definitive", "not_taken", "early", "passing")


def research(turns: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """conv_id, concept, kind, first, last, mentions, with_code, conversations: what became of every concept.

    A conversation has thirds by its largest turn number. definitive: mentioned twice or more, and in the last third, where `last` is its latest wording; not_taken: mentioned
    twice or more, but not in the last third; early: once, in the first third; passing: any other. with_code: how many of the turns that mention it hold
    code; conversations: how many mention it at all.
    """
    mentions = mentions_of(turns) if mentions is None else mentions
    facts = turns.select("conv_id", "turn", F.coalesce(has_code(F.col("text")), F.lit(False)).alias("code"))
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("end"))
    rows = mentions.join(facts, ["conv_id", "turn"]).groupBy("conv_id", "concept").agg(
        F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("mentions"), F.sum(F.col("code").cast("long")).alias("with_code")
    ).join(ends, "conv_id")
    often, late, soon = F.col("mentions") >= 2, F.col("last") * 3 >= F.col("end") * 2, F.col("first") * 3 <= F.col("end")
    kind = F.when(often & late, KINDS[0]).when(often, KINDS[1]).when(soon, KINDS[2]).otherwise(KINDS[3])
    spread = rows.groupBy("concept").agg(F.count("*").alias("conversations"))  # one row a conversation went in
    return rows.withColumn("kind", kind).join(spread, "concept").select("conv_id", "concept", "kind", "first", "last", "mentions", "with_code", "conversations")

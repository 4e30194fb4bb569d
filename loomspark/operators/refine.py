"""Iterative refinement of segments to a target size: rounds of splitting by ever finer criteria and of merging what is too small."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import strip
from loomspark.operators.segment import Segmenter, fixed_chunks
from loomspark.sources.scratch import cutter


def semantic_parts(c: Column) -> Column:
    """Between blank lines and after the end of sentences."""
    return F.split(c, r"(?<=[.!?])\s+|\n\n+", -1)


def syntactic_parts(c: Column) -> Column:
    """After the marks that end clauses."""
    return F.split(c, r"(?<=[,;:])\s+", -1)


def marked_parts(c: Column) -> Column:
    """Before special tokens, which begin with <|."""
    return F.split(c, r"(?=<\|)", -1)


CRITERIA: tuple[Segmenter, ...] = (semantic_parts, syntactic_parts, marked_parts)


def merge_small(pieces: Column, most: int) -> Column:
    """Neighbours joined by a space, greedily from the left, while what they make has at most `most` characters."""
    state = "struct<out:array<string>,cur:string>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur")).cast(state)

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["cur"]) + 1 + F.length(p) <= most
        return (
            F.when(a["cur"].isNull(), F.struct(a["out"].alias("out"), p.alias("cur")))
            .when(fits, F.struct(a["out"].alias("out"), F.concat(a["cur"], F.lit(" "), p).alias("cur")))
            .otherwise(F.struct(F.concat(a["out"], F.array(a["cur"])).alias("out"), p.alias("cur")))
        )

    return F.aggregate(pieces, start, step, lambda a: F.when(a["cur"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def split_and_merge(docs: DataFrame, target: int = 400, slack: float = 1.2, rounds: int = 5, criteria: tuple[Segmenter, ...] = CRITERIA, cut: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """doc_id, ord, content, round: segments of about `target` characters, and the round after which their text was done.

    Round k splits what is longer than target by the k-th criterion, rounds beyond the criteria by characters; then small neighbours are merged up to slack * target. A
    text is done when its segments have on average at most slack * target characters, or when a round by characters changes nothing. Only texts that
    aren't done go on to the next round, and each round is written to the shared folder, so that no expression grows with the rounds. The loop ends when all are done.

    Segments are stripped and never blank. A text that is short enough is one segment of round 0; null, empty and blank texts have none. Rows that repeat an id
    are worked on each, with numbers of their own.
    """
    cut = cut or cutter(docs.sparkSession, "split-merge")
    most = int(slack * target)
    mean_over = lambda ps: F.aggregate(ps, F.lit(0), lambda a, p: a + F.length(p)) > F.size(ps) * most
    state = docs.select("doc_id", F.filter(F.array(strip(F.col("text"))), lambda p: p != "").alias("ps"), F.lit(0).alias("round"))
    state = cut(state.withColumn("open", mean_over("ps")).filter("ps IS NOT NULL"), 0)
    done = [state.filter("NOT open")]
    for k in range(rounds):
        state = state.filter("open")
        if not state.limit(1).count():
            break
        by_size = k >= len(criteria)
        parts = (lambda p: fixed_chunks(p, target)) if by_size else criteria[k]
        split = F.flatten(F.transform("ps", lambda p: F.when(F.length(p) > target, parts(p)).otherwise(F.array(p))))
        kept = F.filter(F.transform(split, strip), lambda p: p != "")
        went_on = state.select("doc_id", F.col("ps").alias("old"), merge_small(kept, most).alias("ps"))
        changed = F.col("ps") != F.col("old") if by_size else F.lit(True)
        state = cut(went_on.select("doc_id", "ps", F.lit(k + 1).alias("round"), (mean_over("ps") & changed).alias("open")), k + 1)
        done.append(state if k == rounds - 1 else state.filter("NOT open"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select("doc_id", "round", F.posexplode("ps").alias("ord", "content")).select("doc_id", "ord", "content", "round")

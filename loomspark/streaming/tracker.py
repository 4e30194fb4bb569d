"""Structured Streaming: segment spans that grow as tokens arrive, paragraphs packed as they arrive, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the begins and ends of a document's segments, and the tokens so far."""
    begins, ends, tokens = ([list(x) if i < 2 else x for i, x in enumerate(state.get)]) if state.exists else ([], [], 0)
    for pdf in batches:
        for r in pdf.sort_values("tok_idx").itertuples():
            tokens = max(tokens, r.tok_idx + 1)
            if r.seg is None or pd.isna(r.seg):
                if not ends:
                    begins.append(0)
                    ends.append(tokens)
                else:
                    ends[-1] = max(ends[-1], r.tok_idx + 1)
                continue
            while len(ends) <= int(r.seg):
                begins.append(r.tok_idx)
                ends.append(r.tok_idx)
            s = int(r.seg)
            begins[s] = min(begins[s], r.tok_idx) if ends[s] > begins[s] else r.tok_idx
            ends[s] = max(ends[s], r.tok_idx + 1)
    state.update((begins, ends, tokens))
    yield pd.DataFrame({"doc_id": key[0], "seg": range(len(ends)), "begin": begins, "end": ends})


def track_segments(tokens: DataFrame) -> DataFrame:
    """doc_id, seg, begin, end after each micro-batch, from a stream of doc_id, tok_idx, seg (null: no decision, the last segment grows)."""
    return tokens.groupBy("doc_id").applyInPandasWithState(
        _grow, "doc_id long, seg int, begin long, end long", "begins array<long>, ends array<long>, tokens long", "update", GroupStateTimeout.NoTimeout
    )


def _pack(size: int, idle_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State: the open window and the number of closed ones. A null text, or a wait beyond the timeout, closes the open window."""
        cur, done = state.get if state.exists else ("", 0)
        out = []

        def close() -> None:
            nonlocal cur, done
            if cur.strip():
                out.append((key[0], done, cur.strip()))
                done += 1
            cur = ""

        if state.hasTimedOut:
            close()
        for pdf in batches:
            for r in pdf.sort_values("ord").itertuples():
                if r.text is None:
                    close()
                elif r.text.strip():
                    if cur and len(cur) + len(r.text) > size:
                        close()
                    cur = f"{cur}\n\n{r.text}" if cur else r.text
        state.update((cur, done))
        if cur and idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["doc_id", "win_idx", "text"])

    return run


def pack_paragraphs(paragraphs: DataFrame, size: int = 1000, idle_ms: int | None = None) -> DataFrame:
    """doc_id, win_idx, text of windows as they close, from a stream of doc_id, ord, text.

    A window closes when the next paragraph would take it beyond size, at a row with a null text (which ends the document for now), and with idle_ms
    when no paragraph has come for so many milliseconds. Without it the last window of a document that is never ended stays in the state.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return paragraphs.groupBy("doc_id").applyInPandasWithState(_pack(size, idle_ms), "doc_id long, win_idx int, text string", "cur string, done int", "append", timeout)


def boundary_counts(boundaries: DataFrame) -> DataFrame:
    """position, strength, n: boundaries of overlapping windows folded as the windows arrive (update mode)."""
    return boundaries.groupBy("position").agg(F.avg("strength").alias("strength"), F.count("*").alias("n"))


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n: events (ts timestamp) by window; rows later than the watermark are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")

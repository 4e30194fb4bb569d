"""Keyed state with timers: segment spans and open windows of documents that end, in Structured Streaming.

State lives in named variables of the state store (maps and lists are read by key and element, not rewritten whole), may expire by a time to live, and timers close documents
from which nothing more comes, so the state follows the documents that are open, not all that ever were. The session needs the RocksDB state store:
spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPANS = "doc_id long, seg int, begin long, end long, closed boolean"
WINDOWS = "doc_id long, win_idx int, text string"


def _rows(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(order)


class _Idle(StatefulProcessor):
    """Keeps one timer a key, idle_ms after its last row."""

    def __init__(self, idle_ms: int | None, ttl_ms: int | None):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def wait(self, timer_values) -> None:
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)

    def close(self) -> None:
        pass


class SegmentSpans(_Idle):
    """spans: a map from segment to its begin and end, which expires after ttl_ms; seen: the last segment and the number of tokens."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "seg int", "begin long, end long", self.ttl_ms)
        self.seen = handle.getValueState("seen", "seg int, tokens long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, tokens = self.seen.get() if self.seen.exists() else (-1, 0)
        changed: dict[int, tuple[int, int]] = {}

        def span(s: int) -> tuple[int, int] | None:
            if s in changed:
                return changed[s]
            return tuple(self.spans.getValue((s,))) if self.spans.containsKey((s,)) else None

        for r in _rows(rows, "tok_idx").itertuples():
            at = int(r.tok_idx)
            tokens = max(tokens, at + 1)
            if pd.isna(r.seg):  # no decision: the last segment grows, or the first begins
                last = max(last, 0)
                have = span(last) or (0, 0)
                changed[last] = (have[0], max(have[1], at + 1))
                continue
            s = int(r.seg)
            for empty in range(last + 1, s):
                changed[empty] = (at, at)
            have = span(s)
            begin = min(have[0], at) if have and have[1] > have[0] else at
            changed[s] = (begin, max(have[1] if have else 0, at + 1))
            last = max(last, s)
        for s, x in changed.items():
            self.spans.updateValue((s,), x)
        self.seen.update((last, tokens))
        self.wait(timerValues)
        yield pd.DataFrame([(key[0], s, b, e, False) for s, (b, e) in sorted(changed.items())], columns=["doc_id", "seg", "begin", "end", "closed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = sorted((k[0], *v) for k, v in self.spans.iterator())
        self.spans.clear()
        self.seen.clear()
        yield pd.DataFrame([(key[0], *x, True) for x in found], columns=["doc_id", "seg", "begin", "end", "closed"])


def track_open_segments(tokens: DataFrame, idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """doc_id, seg, begin, end, closed: the segments that each micro-batch changed, from a stream of doc_id, tok_idx, seg (null: no decision, the last segment grows).

    When idle_ms have passed without a token all segments of a document come once more as closed, and its state goes; tokens after that begin it anew. ttl_ms: state that
    wasn't written for so long goes silently. Segments that are skipped are empty where the next one begins. A null doc_id is a document.
    """
    return tokens.groupBy("doc_id").transformWithStateInPandas(SegmentSpans(idle_ms, ttl_ms), SPANS, "Update", "processingTime")


class OpenWindows(_Idle):
    """open: the list of paragraphs of the window that isn't full yet; counts: its characters and the number of windows closed."""

    def __init__(self, size: int, idle_ms: int | None, ttl_ms: int | None):
        super().__init__(idle_ms, ttl_ms)
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "text string", self.ttl_ms)
        self.counts = handle.getValueState("counts", "chars long, done int", self.ttl_ms)

    def _shut(self, out: list, key: tuple, held: list[str], done: int) -> int:
        text = "\n\n".join(held).strip()
        if text:
            out.append((key[0], done, text))
            done += 1
        held.clear()
        return done

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chars, done = self.counts.get() if self.counts.exists() else (0, 0)
        held = [x[0] for x in self.open.get()] if chars else []
        before, out = len(held), []
        grown = True  # so far the stored list is a prefix of held
        for r in _rows(rows, "ord").itertuples():
            text = None if r.text is None or pd.isna(r.text) else r.text
            if text is None or (held and chars + 2 * (len(held) > 0) + len(text) > self.size and text.strip()):
                done, chars, grown = self._shut(out, key, held, done), 0, False
            if text is not None and text.strip():
                chars += len(text) + 2 * (len(held) > 0)
                held.append(text)
        if grown:
            if len(held) > before:
                self.open.appendList([(x,) for x in held[before:]])
        elif held:
            self.open.put([(x,) for x in held])
        else:
            self.open.clear()
        self.counts.update((chars, done))
        self.wait(timerValues)
        yield pd.DataFrame(out, columns=["doc_id", "win_idx", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        if self.counts.exists():
            chars, done = self.counts.get()
            self._shut(out, key, [x[0] for x in self.open.get()] if chars else [], done)
        self.open.clear()
        self.counts.clear()
        yield pd.DataFrame(out, columns=["doc_id", "win_idx", "text"])


def pack_open_paragraphs(paragraphs: DataFrame, size: int = 1000, idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """doc_id, win_idx, text of windows as they close, from a stream of doc_id, ord, text.

    A window closes before the paragraph that would take it beyond `size` characters, at a row with a null text, and when idle_ms have passed without a row, after which the
    document's state goes and its windows count from 0 again. Blank paragraphs are left out. A paragraph longer than size is a window by itself.
    """
    return paragraphs.groupBy("doc_id").transformWithStateInPandas(OpenWindows(size, idle_ms, ttl_ms), WINDOWS, "Append", "processingTime")

"""Edges in packed chunks, and products of a large sparse matrix with a block of vectors that never make a row for an edge.

A chunk is a row of a written table: up to 2^17 edges of one graph, whose ends are two-byte codes into the chunk's own sorted ids and whose weights are four bytes where six decimals hold them.
A product streams the chunks through Arrow; the vectors, a few numbers for each node, go to the tasks by broadcast, and sums by task and node are shuffled as arrays. Ids are longs without nulls.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "graph_id long, n long, ids binary, a binary, b binary, w binary"
#: How chunks are written: a row is large, so pages and row groups end by their size, not after a hundred rows.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _distinct(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, by a table of marks where the ids lie close together."""
    low, high = (int(ends.min()), int(ends.max())) if len(ends) else (0, -1)
    if high - low >= 8 * len(ends):
        ids, at = np.unique(ends, return_inverse=True)
        return ids, at
    marks = np.zeros(high - low + 1, bool)
    marks[ends - low] = True
    return np.flatnonzero(marks) + low, (np.cumsum(marks) - 1)[ends - low]


def _chunk(graph: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    ids, at = _distinct(np.r_[src, dst])
    at = at.astype(np.uint16 if len(ids) <= 1 << 16 else np.int32)
    order = np.argsort(at[: len(src)], kind="stable")  # runs of one end take little room
    a, b, w = at[: len(src)][order], at[len(src) :][order], weight[order]
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.rint(w * 1e6)
        short = bool((np.abs(whole) < 1 << 31).all() and (whole / 1e6 == w).all())
    parts = [ids, a, b, whole.astype(np.int32) if short else w]
    return pa.record_batch([pa.array([graph]), pa.array([len(src)]), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["graph_id", "n", "ids", "a", "b", "w"])


def _opened(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """ids, both ends as codes, weights of a chunk."""
    n = batch.column("n")[k].as_py()
    held = [batch.column(c)[k].as_buffer() for c in ("ids", "a", "b", "w")]
    code = np.uint16 if held[1].size == 2 * n else np.int32
    w = np.frombuffer(held[3], np.int32) / 1e6 if held[3].size == 4 * n else np.frombuffer(held[3], float)
    return np.frombuffer(held[0], np.int64), np.frombuffer(held[1], code), np.frombuffer(held[2], code), w


def packed(rows: Iterator[tuple[np.ndarray, ...]], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Chunks of arrays (graph_id, src, dst, weight) that come one after another."""
    held, n = [], 0

    def chunks() -> Iterator[pa.RecordBatch]:
        graph, src, dst, weight = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(graph, kind="stable") if (graph != graph[0]).any() else slice(None)
        graph, src, dst, weight = graph[order], src[order], dst[order], weight[order]
        cuts = np.flatnonzero(np.r_[True, graph[1:] != graph[:-1]])
        for low, high in zip(cuts, np.r_[cuts[1:], len(graph)]):
            for at in range(low, high, most):
                own = slice(at, min(at + most, high))
                yield _chunk(int(graph[at]), src[own], dst[own], weight[own])

    for row in rows:
        if len(row[0]):
            held.append(row)
            n += len(row[0])
        if n >= most:
            yield from chunks()
            held, n = [], 0
    if held:
        yield from chunks()


def pack(edges: DataFrame) -> DataFrame:
    """Chunks of edges (graph_id, src, dst, weight), none of them null. Edges stay in the task where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)) for batch in batches)

    return edges.select(*[F.col(c).cast("long").alias(c) for c in ("graph_id", "src", "dst")], F.col("weight").cast("double").alias("weight")).mapInArrow(run, CHUNKS)


def unpack(chunks: DataFrame) -> DataFrame:
    """graph_id, src, dst, weight of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, a, b, w = _opened(batch, k)
                yield pa.record_batch([pa.array(np.full(len(a), batch.column("graph_id")[k].as_py(), np.int64)), pa.array(ids[a]), pa.array(ids[b]), pa.array(w)], ["graph_id", "src", "dst", "weight"])

    return chunks.mapInArrow(run, "graph_id long, src long, dst long, weight double")


def ends(chunks: DataFrame, most: int = 1 << 20) -> DataFrame:
    """id: each end of the chunks' edges once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                seen = np.union1d(seen, np.frombuffer(x.as_buffer(), np.int64))
                if len(seen) > most:
                    yield pa.record_batch([pa.array(seen)], ["id"])
                    seen = seen[:0]
        yield pa.record_batch([pa.array(seen)], ["id"])

    return chunks.select("ids").mapInArrow(run, "id long").distinct()


def _places(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where some of the sorted ids stand."""
    return some - ids[0] if ids[-1] - ids[0] + 1 == len(ids) else np.searchsorted(ids, some)


def _added(ids, vectors, ways: str, width: int, part_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ids, v = ids.value, vectors.value
        total = np.zeros((width, len(all_ids)))
        for batch in batches:
            for k in range(batch.num_rows):
                own, a, b, w = _opened(batch, k)
                at = _places(all_ids, own)
                a, b = a.astype(np.int64), b.astype(np.int64)
                back = np.where(a == b, 0.0, w) if ways == "both" else w  # a loop counts once
                for c in range(width):
                    x, s = v[c][at], np.zeros(len(own))
                    if ways != "back":
                        s += np.bincount(b, w * x[a], len(own))
                    if ways != "there":
                        s += np.bincount(a, back * x[b], len(own))
                    total[c][at] += s
        for part in range(-(-len(all_ids) // part_rows)):
            own = total[:, part * part_rows : (part + 1) * part_rows]
            at = np.flatnonzero(own.any(axis=0)).astype(np.int32)
            if len(at):
                yield pa.record_batch([pa.array([part]), pa.array([at.tobytes()], pa.binary()), pa.array([own[:, at].tobytes()], pa.binary())], ["part", "at", "s"])

    return run


def _merged(width: int, part_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, part_rows))
        for batch in batches:
            part = batch.column("part")[0].as_py()
            for at, s in zip(batch.column("at"), batch.column("s")):
                total[:, np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(s.as_buffer(), float).reshape(width, -1)
        yield pa.record_batch([pa.array([part]), pa.array([total.tobytes()], pa.binary())], ["part", "s"])

    return run


@contextlib.contextmanager
def _small_batches(spark: SparkSession, size: int = 4 << 20):
    """Arrow batches of a few chunks, for what is run inside: buffers stay small on both sides."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def product(chunks: DataFrame, ids: np.ndarray) -> Callable[[np.ndarray, str], np.ndarray]:
    """times(v, ways): the chunks' matrix times the rows of v, (width, nodes) numbers in the order of the sorted ids, which hold all ends. ways: there (from src to dst), back, or both, where a loop counts once."""
    context = chunks.sparkSession.sparkContext
    held = context.broadcast(ids)

    def times(v: np.ndarray, ways: str = "both") -> np.ndarray:
        width, n = v.shape
        part_rows = max(1, (1 << 16) // width)
        sent = context.broadcast(v)
        sums = chunks.select("n", "ids", "a", "b", "w").mapInArrow(_added(held, sent, ways, width, part_rows), "part long, at binary, s binary")
        out = np.zeros((width, n))
        with _small_batches(chunks.sparkSession):
            merged = sums.groupBy("part").applyInArrow(_merged(width, part_rows), "part long, s binary").toArrow()
        for batch in merged.to_batches():
            for part, s in zip(batch.column("part").to_pylist(), batch.column("s")):
                own = out[:, part * part_rows : (part + 1) * part_rows]
                own += np.frombuffer(s.as_buffer(), float).reshape(width, part_rows)[:, : own.shape[1]]
        sent.destroy()
        return out

    return times


def column(df: DataFrame, name: str) -> np.ndarray:
    """A column of numbers; for tables whose rows were counted."""
    return df.select(name).toArrow().column(name).to_numpy()

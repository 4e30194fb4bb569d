"""Spectral clustering of weighted graphs by joins and small driver-side algebra.

The normalised Laplacian's smallest eigenvectors are found by block power iteration on its complement, 2 I - L: one round multiplies the sparse matrix with a block of
k vectors, a join and a sum for all columns at once; what the driver sees of a round are k by k products of the block with itself. Rows of the eigenvectors,
brought to length 1, are then grouped by k-means, of which the driver holds k centres.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators import packed
from loomspark.operators.skew import hot_split_join
from loomspark.sources.scratch import cutter


def normalised(edges: DataFrame) -> DataFrame:
    """src, dst, w = weight / sqrt(degree of src * degree of dst), both ways, from undirected edges (src, dst, weight over 0); repeated ones are summed.
    A loop counts once to its node's degree. Null ends and weights, and weights of 0 or less, are left out."""
    rows = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND weight > 0").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    both = rows.unionByName(rows.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    degree = both.groupBy("src").agg(F.sum("weight").alias("d"))
    ends = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return ends.select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def _degrees(rows: DataFrame) -> DataFrame:
    """id, d, rows of undirected edges (src, dst, weight), each there once: the sum of its node's weights, a loop's once, and how many they are. Each end is added up where it lies."""
    ends = [rows.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d"), F.count("*").alias("rows")), rows.filter("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("d"), F.count("*").alias("rows"))]
    return ends[0].unionByName(ends[1]).groupBy("id").agg(F.sum("d").alias("d"), F.sum("rows").alias("rows"))


def _block(column: pa.Array, b: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, b)


def _products(moved: DataFrame, b: int) -> tuple[np.ndarray, ...]:
    """The b by b products old'old, old'v and v'v: each task adds up its rows, the driver gets their sums."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, b, b))
        for batch in batches:
            old, v = (_block(batch.column(c), b) for c in ("old", "v"))
            total += np.stack([old.T @ old, old.T @ v, v.T @ v])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(3 * b * b)), pa.array(total.ravel())], ["k", "x"])

    out = np.zeros(3 * b * b)
    for r in moved.select("old", "v").mapInArrow(part, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r.k] = r.x
    return tuple(out.reshape(3, b, b))


def _times(v: str, m: np.ndarray) -> Column:
    """A row vector times a small matrix."""

    @F.arrow_udf("array<double>")
    def turned(rows: pa.Array) -> pa.Array:
        out = _block(rows, len(m)) @ m
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, m.shape[1]), pa.int32()), pa.array(out.ravel()))

    return turned(v)


def smallest_eigenvectors(matrix: DataFrame, k: int, rounds: int = 60, tolerance: float = 1e-7, extra: int = 2, cut: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(id, v: k components), and the k smallest eigenvalues of the normalised Laplacian of `matrix` (src, dst, w of `normalised`).

    Each round: multiply, bring the block to orthonormal by its k + extra square product, and solve the small projected problem. It ends when no eigenvalue moves
    by more than tolerance. The start is hashes of the ids, so that runs agree. Hubs' rows are split by hot_split_join. A graph of fewer than k nodes has fewer.
    """
    cut = cut or cutter(matrix.sparkSession, "spectral")
    matrix = cut(matrix, "matrix")
    nodes = cut(matrix.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("rows")), "nodes")
    return _iterated(nodes, lambda block, width: _summed(hot_split_join(matrix, block.withColumnRenamed("id", "dst"), "dst", "rows"), "src", width), k, rounds, tolerance, extra, cut)


def smallest_eigenvectors_of_edges(edges: DataFrame, k: int, rounds: int = 60, tolerance: float = 1e-7, extra: int = 2, cut: Callable[[DataFrame, int], DataFrame] | None = None, most_broadcast: int = 1_000_000) -> tuple[DataFrame, np.ndarray]:
    """smallest_eigenvectors of normalised(edges), where the matrix is never made: edges are written once, each stands for both ways, and degrees divide the vectors instead.

    Up to most_broadcast nodes, which are counted, vectors go to the edges by broadcast and only sums by task and node are shuffled; beyond, by hot_split_join. Repeated edges
    add up in the sums.
    """
    cut = cut or cutter(edges.sparkSession, "spectral")
    rows = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND weight > 0").select("src", "dst", F.col("weight").cast("double").alias("w"))
    rows = cut(rows, "edges")
    nodes = cut(_degrees(rows.withColumnRenamed("w", "weight")).withColumn("d", F.sqrt("d")), "nodes")

    def times(block: DataFrame, width: int) -> DataFrame:
        scaled = block.select("id", "rows", F.transform("v", lambda x: x / F.col("d")).alias("v"))
        ways = [("src", "dst", rows), ("dst", "src", rows.filter("src <> dst"))]
        parts = [_summed(hot_split_join(r, scaled.withColumnRenamed("id", a), a, "rows", most_broadcast=most_broadcast), b, width) for a, b, r in ways]
        sums = parts[0].unionByName(parts[1]).groupBy("id").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in range(width)])
        return sums.join(nodes.select("id", "d"), "id").select("id", *[(F.col(f"s{c}") / F.col("d")).alias(f"s{c}") for c in range(width)])

    return _iterated(nodes, times, k, rounds, tolerance, extra, cut)


def _summed(met: DataFrame, end: str, width: int) -> DataFrame:
    return met.groupBy(F.col(end).alias("id")).agg(*[F.sum(F.col("w") * F.get("v", F.lit(c))).alias(f"s{c}") for c in range(width)])


def _start(c: int) -> Column:
    """A node's first number in column c: a hash of its id."""
    return F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1 << 20)) / (1 << 20) - 0.5


def _turned(oo: np.ndarray, ov: np.ndarray, vv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, of the operator on the span of old, oo x l = ov x, and what turns v to their vectors at length 1."""
    b = len(oo)
    root = np.linalg.cholesky((oo + oo.T) / 2 + 1e-13 * np.trace(oo) / b * np.eye(b))
    inner = np.linalg.solve(root, np.linalg.solve(root, (ov + ov.T) / 2).T)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    turn = np.linalg.solve(root.T, vectors[:, ::-1])
    return values[::-1], turn / np.sqrt(np.maximum(np.einsum("ab,ac,cb->b", turn, vv, turn), 1e-300))


def _iterated(nodes: DataFrame, times: Callable[[DataFrame, int], DataFrame], k: int, rounds: int, tolerance: float, extra: int, cut: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, np.ndarray]:
    """The block iteration: nodes (id and what goes along), times(block, width): (id, s0, s1, ...), the matrix times the block."""
    n = nodes.count()
    b = min(n, k + extra)
    along = [c for c in nodes.columns if c != "id"]
    if not n:
        return nodes.select("id", F.array().cast("array<double>").alias("v")), np.empty(0)
    start = F.array(*[_start(c) for c in range(b)])
    block = cut(nodes.select("id", *along, start.alias("v")), "start")
    last = np.full(b, np.inf)
    for round_ in range(rounds):
        sums = times(block, b)
        # (2 I - L) v = v + W v: all its eigenvalues lie between 0 and 2
        moved = block.join(sums, "id").select("id", *along, F.col("v").alias("old"), F.array(*[F.get("v", F.lit(c)) + F.col(f"s{c}") for c in range(b)]).alias("v"))
        moved = cut(moved, f"moved-{round_}")
        oo, ov, vv = _products(moved, b)
        values, turn = _turned(oo, ov, vv)
        block = moved.select("id", *along, _times("v", turn).alias("v"))
        if np.abs(values - last)[: min(k, b)].max() < tolerance:
            break
        last = values
    return cut(block.select("id", F.slice("v", 1, min(k, b)).alias("v")), "vectors"), 2 - values[: min(k, b)]


def smallest_eigenvectors_of_chunks(chunks: DataFrame, k: int, rounds: int = 60, tolerance: float = 1e-7, extra: int = 2, cut: Callable[[DataFrame, int], DataFrame] | None = None, most_held: int = 1 << 23) -> tuple[DataFrame, np.ndarray]:
    """smallest_eigenvectors of packed edges (`packed.pack`) with weights over 0, which are written once and never become rows.

    Up to most_held numbers of a block (nodes, which are counted, times k + extra) the driver holds it and sends it to the chunks each round; beyond, smallest_eigenvectors_of_edges.
    """
    cut = cut or cutter(chunks.sparkSession, "spectral", **packed.PAGES)
    chunks = cut(chunks, "chunks")
    nodes = cut(packed.ends(chunks), "ends")
    n = nodes.count()
    b = min(n, k + extra)
    if not n or n * b > most_held:
        return smallest_eigenvectors_of_edges(packed.unpack(chunks), k, rounds, tolerance, extra, cut)
    rows = nodes.select("id", *[_start(c).alias(f"s{c}") for c in range(b)]).toArrow().sort_by("id")
    ids = rows["id"].to_numpy()
    block = np.stack([rows[f"s{c}"].to_numpy() for c in range(b)])
    del rows
    product = packed.product(chunks, ids)
    d = np.sqrt(product(np.ones((1, n)))[0])
    last = np.full(b, np.inf)
    for _ in range(rounds):
        moved = block + product(block / d) / d
        values, turn = _turned(block @ block.T, block @ moved.T, moved @ moved.T)
        block = turn.T @ moved
        if np.abs(values - last)[: min(k, b)].max() < tolerance:
            break
        last = values
    width = min(k, b)
    v = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(block[:width].T.ravel()))
    return cut(chunks.sparkSession.createDataFrame(pa.table([pa.array(ids), v], ["id", "v"])), "vectors"), 2 - values[:width]


def spectral_clusters(edges: DataFrame, clusters: int, rounds: int = 24, tolerance: float = 1e-4, steps: int = 20, cut: Callable[[DataFrame, int], DataFrame] | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """id, cluster (from 0, by the smallest id that it holds) of every node of the undirected weighted edges (src, dst, weight).

    Rows of the eigenvectors at length 1 are grouped by k-means. Its first centres are those of a sample of at most 1000 nodes, by a hash, taken farthest first; each step
    assigns all rows and averages them, and stops when no centre moves. chunks: the edges packed, with weights over 0; otherwise edges between longs are packed here.
    """
    cut = cut or cutter(edges.sparkSession, "spectral-clusters")
    if chunks is None and all(f.dataType.typeName() in ("byte", "short", "integer", "long") for f in edges.select("src", "dst").schema):
        chunks = packed.pack(edges.filter("src IS NOT NULL AND dst IS NOT NULL AND weight > 0").select(F.lit(0).alias("graph_id"), "src", "dst", "weight"))
    vectors, _ = smallest_eigenvectors_of_edges(edges, clusters, rounds, tolerance) if chunks is None else smallest_eigenvectors_of_chunks(chunks, clusters, rounds, tolerance)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = cut(vectors.withColumn("length", length).select("id", F.when(F.col("length") > 0, F.transform("v", lambda x: x / F.col("length"))).otherwise(F.col("v")).alias("v")), "rows")
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(1000).collect()], float)  # the bound of what the driver sees
    if not len(sample):
        return rows.select("id", F.lit(0).alias("cluster"))
    centres = sample[:1]
    while len(centres) < min(clusters, len(sample)):
        far = ((sample[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.vstack([centres, sample[int(far.argmax())]])

    def nearest(centres: np.ndarray) -> Column:
        apart = [F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in centres]
        return F.array_min(F.array(*[F.struct(F.round(d, 12).alias("d"), F.lit(j).alias("j")) for j, d in enumerate(apart)]))["j"]

    width = centres.shape[1]
    for _ in range(steps):
        sums = rows.withColumn("c", nearest(centres)).groupBy("c").agg(*[F.avg(F.get("v", F.lit(a))).alias(f"m{a}") for a in range(width)]).collect()  # a row a centre
        new = centres.copy()
        for r in sums:
            new[r.c] = [r[f"m{a}"] for a in range(width)]
        if np.abs(new - centres).max() < 1e-9:
            break
        centres = new
    found = cut(rows.select("id", nearest(centres).alias("c")), "found")
    firsts = sorted((r.m, r.c) for r in found.groupBy("c").agg(F.min("id").alias("m")).collect())
    number = F.create_map(*[F.lit(x) for pair in ((c, k) for k, (_, c) in enumerate(firsts)) for x in pair])
    return found.select("id", number[F.col("c")].alias("cluster"))

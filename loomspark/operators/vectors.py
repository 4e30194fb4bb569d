"""Vectors: similarity pairs, scatter aggregation and pooling between tokens, segments and nodes.

Where a function says nothing else: null vectors give no components, null components are skipped by means, sums and maxima, a null index is a group of its
own, and empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import dot
from loomspark.operators import packed

PAIRS = "src long, dst long, weight double"


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which rows stand on the first side, and the vectors of one length."""
    lists = table["vec"].combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return table["id"].to_numpy(), table["is_row"].to_numpy(zero_copy_only=False), values.reshape(len(lists), -1)


def _floor(mat: np.ndarray, threshold: float) -> tuple[np.ndarray, float]:
    """The vectors as floats, and a value that the float product of any two over the threshold exceeds: rounding moves a product by less than (dimensions + 4) / 2^23 of the longest length squared.
    Vectors that floats may not hold stay as they are, with the same sums on both sides of the bound."""
    longest = float(np.sqrt((mat * mat).sum(axis=1).max(initial=0.0)))
    if not longest < 1e15:
        return mat, -np.inf
    return mat.astype(np.float32), float(np.float32(threshold - (mat.shape[1] + 4) * 2.0**-23 * longest * longest - 1e-30)) - abs(threshold) * 2.0**-22


def _block_pairs(threshold: float, most_products: int = 1 << 21, most_held: int = 1 << 15):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One cell of the grid: products of its rows' vectors with its columns', those over the threshold kept. Products are made and given out slice by slice:
        in floats, and those that rounding leaves open or over the threshold once more in doubles."""
        table = pa.Table.from_batches(batches)
        same = table["x"][0].as_py() == table["y"][0].as_py()
        ids, side, mat = _matrix(table)
        cols = np.flatnonzero(~side)
        others, second = ids[cols], mat[cols]
        rows = np.flatnonzero(side)
        near, least = _floor(mat, threshold)
        right = near[cols].T
        step = max(1, most_products // max(1, len(cols)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            prod = near[part] @ right
            spot = np.flatnonzero(prod.ravel() > least)
            i, j = np.divmod(spot, len(cols)) if len(cols) else (spot, spot)
            if same:
                own = ids[part][i] < others[j]
                i, j = i[own], j[own]
            first = mat[part]
            if len(i) * 8 > prod.size:
                w = (first @ second.T)[i, j]
            else:
                w = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", first[i[k : k + most_held]], second[j[k : k + most_held]]) for k in range(0, len(i), most_held)]])
            keep = w > threshold
            a, b = ids[part][i[keep]], others[j[keep]]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(w[keep])], ["src", "dst", "weight"])

    return pairs


def _grid(vectors: DataFrame, block_rows: int, wider: int = 1) -> DataFrame:
    """x <= y, dim, id, vec, is_row: each pair of blocks once. Beyond 16 blocks, they become up to `wider` times as large before there are more, since each vector
    is sent once for each block. Vectors that are null or hold nulls, and null ids, take no part."""
    ok = F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull()) & (F.size("vec") > 0)
    v = vectors.select(F.col("id").cast("long").alias("id"), "vec", F.size("vec").alias("dim")).filter(ok)
    n = v.count()
    blocks = max(1, min(-(-n // block_rows), 16), -(-n // (wider * block_rows)))
    v = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    rows = v.select("id", "vec", "dim", F.col("b").alias("x"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("y"), F.lit(True).alias("is_row"))
    cols = v.select("id", "vec", "dim", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("x"), F.col("b").alias("y"), F.lit(False).alias("is_row"))
    return rows.unionByName(cols)


def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int = 4096) -> DataFrame:
    """src < dst, weight: all pairs of (id, vec) rows with a dot product strictly over threshold.

    A grid of blocks by hash of id, as many as the rows need: each pair of blocks meets once, in Arrow products of a bounded slice, so a task holds two
    blocks' vectors and one slice, and only matches leave it. Blocks hold up to 8 times block_rows. Vectors meet vectors of their own length; those that are null, empty or hold nulls, and null ids, take no part.
    """
    return _grid(vectors, block_rows, 8).groupBy("x", "y", "dim").applyInArrow(_block_pairs(threshold), PAIRS)


def similar_chunks(vectors: DataFrame, threshold: float, block_rows: int = 4096, decimals: int = 6) -> DataFrame:
    """similar_pairs as packed chunks (`packed.pack`) of graph 0 with weights to so many decimals, made where the products are, so that no row is made for a pair."""
    found, scale = _block_pairs(threshold), 10.0**decimals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for_each = (tuple(x.to_numpy() for x in b.columns) for b in found(batches))
        return packed.packed((np.zeros(len(a), np.int64), a, b, np.rint(w * scale) / scale) for a, b, w in for_each)

    return _grid(vectors, block_rows, 8).groupBy("x", "y", "dim").applyInArrow(run, packed.CHUNKS)


def _block_nearest(k: int):
    def best(table: pa.Table) -> pa.Table:
        """One cell: for each vector of either side its k best of the other, and what lies within rounding of the last."""
        ids, side, mat = _matrix(table)
        rows, cols = np.flatnonzero(side), np.flatnonzero(~side)
        prod = mat[rows] @ mat[cols].T
        prod[ids[rows][:, None] == ids[cols][None, :]] = -np.inf
        out = []
        same = table["x"][0].as_py() == table["y"][0].as_py()
        for a, b, p in ((rows, cols, prod),) if same else ((rows, cols, prod), (cols, rows, prod.T)):
            if not len(a) or not len(b):
                continue
            at = max(0, p.shape[1] - k)
            floor = np.partition(p, at, axis=1)[:, at] - 1e-6
            i, j = np.nonzero((p >= floor[:, None]) & (p > -np.inf))
            out.append((ids[a][i], ids[b][j], p[i, j]))
        src, dst, weight = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([pa.array(src), pa.array(dst), pa.array(weight)], ["src", "dst", "weight"])

    return best


def nearest(vectors: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """src, rank, dst, weight (6 decimals): each vector's k most similar others, ties to the smaller id.

    Each pair of blocks gives about k rows a vector, and those are merged; the cases are those of similar_pairs.
    """
    found = _grid(vectors, block_rows).groupBy("x", "y", "dim").applyInArrow(_block_nearest(k), PAIRS).withColumn("weight", F.round("weight", 6))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def adjacent_similarity(rows: DataFrame, group: list[str], order: str, vec: str) -> DataFrame:
    """Each row's dot product with the row before it."""
    return rows.withColumn("sim", dot(F.lag(vec).over(Window.partitionBy(*group).orderBy(order)), F.col(vec)))


def scatter(rows: DataFrame, index: str, vec: str, how: str = "mean") -> DataFrame:
    """index, dim, value: the mean, sum or max of vec's components by index."""
    flat = rows.select(index, F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max}
    if how not in agg:
        raise ValueError(f"how is one of {sorted(agg)}")
    return flat.groupBy(index, "dim").agg(agg[how]("x").alias("value"))


def scatter_dense(rows: DataFrame, index: str, vec: str, size: int, how: str = "mean") -> DataFrame:
    """scatter with a row for every index below size; empty ones are 0."""
    got = scatter(rows, index, vec, how)
    full = rows.sparkSession.range(size).withColumnRenamed("id", index).crossJoin(F.broadcast(got.select("dim").distinct()))
    return full.join(got, [index, "dim"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def scatter_argmax(rows: DataFrame, index: str, vec: str, arg: str) -> DataFrame:
    """index, dim, value, arg: each component's maximum and the smallest arg that has it."""
    flat = rows.select(index, arg, F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    best = F.max(F.struct("x", (-F.col(arg)).alias("neg")))
    return flat.groupBy(index, "dim").agg(best.alias("b")).select(index, "dim", F.col("b.x").alias("value"), (-F.col("b.neg")).alias(arg))


def weighted_pool(rows: DataFrame, index: str, vec: str, weight: Column) -> DataFrame:
    """index, dim, value: sum of weight times component over at least 1e-6 of weight."""
    flat = rows.select(index, weight.alias("w"), F.posexplode(vec).alias("dim", "x"))
    return flat.groupBy(index, "dim").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("value"))


def distribute(tokens: DataFrame, nodes: DataFrame, index: str, how: str = "add", gate: float = 0.0) -> DataFrame:
    """tokens (index, dim, value, other columns) with their node's component (index, dim, node_value): added, or mixed by the gate's sigmoid."""
    rows = tokens.join(nodes, [index, "dim"])
    g = 1 / (1 + F.exp(F.lit(-gate)))
    value = {"add": F.col("value") + F.col("node_value"), "gated": g * F.col("value") + (1 - g) * F.col("node_value")}
    if how == "concat":
        return rows.withColumn("value", F.array("value", "node_value")).drop("node_value")
    return rows.withColumn("value", value[how]).drop("node_value")


def node_masks(rows: DataFrame, index: str, nodes: int) -> DataFrame:
    """mask: for each row a boolean for every node."""
    return rows.withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda n: n == F.col(index)))


def range_pool(rows: DataFrame, ranges: DataFrame, position: str, vec: str, how: str = "mean", bin_size: int = 64) -> DataFrame:
    """seg, dim, value over half-open ranges (seg, begin, end). Ranges meet positions by bins, not in a nested loop."""
    binned = ranges.filter("end > begin").withColumn("bin", F.explode(F.sequence(F.floor(F.col("begin") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    hit = rows.withColumn("bin", F.floor(F.col(position) / bin_size)).join(binned, "bin").filter((F.col(position) >= F.col("begin")) & (F.col(position) < F.col("end")))
    return scatter(hit, "seg", vec, how)


def mean_by_node(windows: DataFrame, node: str, vec: str) -> DataFrame:
    """Overlapping windows' embeddings of a node, averaged."""
    return scatter(windows, node, vec, "mean")


def pooled_levels(tokens: DataFrame, levels: list[DataFrame], vec: str = "vec") -> list[DataFrame]:
    """Means level by level: tokens (id, vec); each level (id, parent) groups the one below. Returns (id, vec) of each."""
    out, below = [], tokens.select("id", vec)
    for groups in levels:
        flat = below.join(groups, "id").select("parent", F.posexplode(vec).alias("dim", "x")).groupBy("parent", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
        below = flat.groupBy(F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"]).alias(vec))
        out.append(below)
    return out


def dual_embeddings(tokens: DataFrame, mapping: DataFrame, id_col: str = "tok", node: str = "seg", vec: str = "vec") -> DataFrame:
    """tok, seg, vec, node_vec: each token's own embedding beside its node's mean. Tokens without a node have a null one.

    tokens: tok, vec; mapping: tok, seg (null: no node). Vectors of a node should be of one length.
    """
    rows = tokens.join(mapping.select(id_col, node), id_col, "left")
    flat = scatter(rows.filter(F.col(node).isNotNull()), node, vec, "mean")
    means = flat.groupBy(node).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda r: r["value"]).alias("node_vec"))
    return rows.join(means, node, "left").select(id_col, node, vec, "node_vec")

"""Graph construction and analytics over edge tables (src, dst, weight, edge_type), many graphs at once by graph_id or doc_id.

Where a function says nothing else: empty tables give empty tables (whole-graph statistics one row), rows with null keys join nothing, a null edge type counts as 0
and a null weight as 1, and repeated edges count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomspark.operators import packed
from loomspark.operators.skew import hot_split_join, ranked_rows, running_totals
from loomspark.sources.scratch import cutter

# fixed values: edge types in the order of their codes, and the bias of each
EDGE_TYPES = ["NO_RELATION", "EXPLAINS", "ELABORATES", "CONTRADICTS", "IS_EXAMPLE_OF", "IS_CONSEQUENCE_OF", "DEPENDS_ON", "SUMMARIZES", "REFERENCES", "CONTINUES"]
EDGE_BIAS = [0.0, 0.05, 0.03, -0.1, 0.04, 0.06, 0.08, 0.07, 0.02, 0.01]


def edge_type_dim(spark) -> DataFrame:
    return spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate(zip(EDGE_TYPES, EDGE_BIAS))], "edge_type int, name string, default_bias double")


def new_semantic_edges(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs without an edge in either direction."""
    low, high = F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    have = existing.select(low, high).distinct()
    return pairs.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(have, ["lo", "hi"], "left_anti").select("src", "dst", "weight", F.lit("semantic_similarity").alias("type"))


def upsert_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each ordered pair: the latest."""
    w = Window.partitionBy("src", "dst").orderBy(F.desc(order))
    return edges.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def adjacency(cells: DataFrame, threshold: float = 0.1, symmetric: bool = False) -> DataFrame:
    """Cells (i, j, w) over the threshold as 1.0; symmetric takes the larger of both directions."""
    hit = cells.filter(F.col("w") > threshold).select("i", "j", F.lit(1.0).alias("w"))
    if not symmetric:
        return hit
    return hit.unionByName(hit.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.max("w").alias("w"))


def sparsify(cells: DataFrame, k: int | None = None, threshold: float | None = None) -> DataFrame:
    """The k largest of each row (ties to smaller j) and over the threshold; neither keeps nothing."""
    if not k and threshold is None:
        return cells.limit(0)
    if k:
        cells = cells.withColumn("__k", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("w"), "j"))).filter(F.col("__k") <= k).drop("__k")
    return cells if threshold is None else cells.filter(F.col("w") > threshold)


def merge_windows(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """Mean of the covering windows for each cell: cells (window_idx, i, j, w), starts (window_idx, start)."""
    moved = cells.join(starts, "window_idx").select((F.col("i") + F.col("start")).alias("i"), (F.col("j") + F.col("start")).alias("j"), "w")
    return moved.groupBy("i", "j").agg(F.avg("w").alias("w"))


def stitch_windows(cells: DataFrame, stride: int, size: int) -> DataFrame:
    """Mean weighted towards the windows' centres, for each layer, head and cell."""
    far = F.greatest(F.abs(F.col("i") - size / 2), F.abs(F.col("j") - size / 2))
    rows = cells.withColumn("wt", 1 - 0.5 * far / (size / 2)).withColumn("at", F.col("window_idx") * stride)
    rows = rows.withColumns({"i": F.col("i") + F.col("at"), "j": F.col("j") + F.col("at")})
    return rows.groupBy("layer", "head", "i", "j").agg((F.sum(F.col("w") * F.col("wt")) / F.sum("wt")).alias("w"))


def dual_level_edges(node_cells: DataFrame, token_cells: DataFrame | Column, least: float = 0.1, types: DataFrame | Column | None = None) -> DataFrame:
    """i, j, weight = (2 node + token) / 3, edge_type for cells off the diagonal with node attention over least. A missing token cell is 0, as is a
    missing type (types: i, j, edge_type). Where a row of node_cells also knows its token cell or type, these are columns of it (null: missing), and nothing is joined."""
    rows = node_cells.filter((F.col("i") != F.col("j")) & (F.col("w") > least))
    if isinstance(token_cells, Column):
        rows = rows.withColumn("tok", token_cells)
    else:
        rows = rows.join(token_cells.select("i", "j", F.col("w").alias("tok")), ["i", "j"], "left")
    if isinstance(types, Column):
        rows = rows.withColumn("__t", types)
    elif types is not None:
        rows = rows.join(types.select("i", "j", F.col("edge_type").alias("__t")), ["i", "j"], "left")
    kind = F.coalesce("__t", F.lit(0)) if types is not None else F.lit(0)
    return rows.select("i", "j", ((2 * F.col("w") + F.coalesce("tok", F.lit(0.0))) / 3).alias("weight"), kind.cast("int").alias("edge_type"))


def node_strengths(segments: DataFrame, node_cells: DataFrame, n: int, cohesion: DataFrame | None = None) -> DataFrame:
    """segments (i) plus strength, the mean of a row's n cells (0 without any), and cohesion (0 where none is known)."""
    out = segments.join(node_cells.groupBy("i").agg((F.sum("w") / n).alias("strength")), "i", "left").na.fill(0.0, ["strength"])
    if cohesion is None:
        return out.withColumn("cohesion", F.lit(0.0))
    return out.join(cohesion.select("i", "cohesion"), "i", "left").na.fill(0.0, ["cohesion"])


def attention_edges(cells: DataFrame, threshold: float = 0.1) -> DataFrame:
    """src, dst, weight of the cells over the threshold."""
    return cells.filter(F.col("w") > threshold).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("w").alias("weight"))


def dual_adjacency(node_cells: DataFrame, windows: int, n: int) -> DataFrame:
    """i, j, w (summed over windows and layers, over the number of windows), linked: over mean plus deviation of all n * n cells. Cells i, j < n."""
    w = node_cells.filter((F.col("i") < n) & (F.col("j") < n)).groupBy("i", "j").agg((F.sum("w") / windows).alias("w"))
    return w.crossJoin(F.broadcast(dense_threshold(w, n))).select("i", "j", "w", (F.col("w") > F.col("threshold")).alias("linked"))


def dense_threshold(cells: DataFrame, n: Column | int, group: list[str] | None = None) -> DataFrame:
    """Mean plus population deviation over all n * n cells, missing ones 0."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("double")  # n * n leaves the integers from 46,341 nodes on
    mean = F.sum("w") / (n * n)
    return cells.groupBy(*(group or [])).agg((mean + F.sqrt(F.greatest(F.sum(F.col("w") * F.col("w")) / (n * n) - mean * mean, F.lit(0.0)))).alias("threshold"))


def by_types(edges: DataFrame, types: list[int]) -> DataFrame:
    return edges.filter(F.coalesce("edge_type", F.lit(0)).isin(types))


def induced(edges: DataFrame, kept: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """Edges with both ends in kept (id). Up to most_broadcast ids, which are counted, go to the edges; beyond, both are shuffled."""
    if kept.count() <= most_broadcast:
        kept = F.broadcast(kept)
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")


def adjacency_lists(nodes: DataFrame, edges: DataFrame, part_rows: int = 1 << 20) -> DataFrame:
    """id, part, neighbours (both directions, duplicates kept, sorted). A hub's come in parts by hash, each of about part_rows; others have part 0 alone.
    The edges among nodes are written once, as they are read for the counts and the lists of both directions."""
    e = cutter(edges.sparkSession, "lists")(induced(edges, nodes).select("src", "dst"), "edges")
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    lists = listed_by(both, "src", "dst", part_rows).withColumnsRenamed({"src": "id", "dst": "neighbours"})
    return nodes.join(lists, "id", "left").withColumns({"neighbours": F.coalesce("neighbours", F.array().cast("array<bigint>")), "part": F.coalesce("part", F.lit(0))})


def listed_by(rows: DataFrame, key: str, value: str, part_rows: int) -> DataFrame:
    """key, part, value (sorted array): a key with more than part_rows rows in several parts by hash of the value."""
    parts = rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > part_rows).select(key, F.ceil(F.col("__n") / part_rows).cast("int").alias("__p"))
    split = rows.join(F.broadcast(parts), key, "left")  # no more than one in part_rows of all rows
    part = F.coalesce(F.pmod(F.xxhash64(value), F.col("__p")).cast("int"), F.lit(0))
    return split.withColumn("part", part).groupBy(key, "part").agg(F.array_sort(F.collect_list(value)).alias(value))


def spread_sample(edges: DataFrame, most: int = 20) -> DataFrame:
    """At most `most` edges at an even stride of (src, dst), for relation classification. The edges are written once and counted by src; running totals tell which
    few src hold the asked places, and only their edges are ordered, in ranges, so a hub's don't meet in a task."""
    e = cutter(edges.sparkSession, "sample")(edges, "edges")
    totals = running_totals(e.groupBy(F.col("src").alias("__src")).agg(F.count("*").alias("__n")), "__src", "__n", "__before")
    stride = totals.agg(F.greatest(F.floor(F.coalesce(F.sum("__n"), F.lit(0)) / most), F.lit(1)).alias("__s"))
    first = F.ceil(F.col("__before") / F.col("__s"))  # the first asked place at or behind those before
    picked = totals.crossJoin(F.broadcast(stride)).filter((first < most) & (first * F.col("__s") < F.col("__before") + F.col("__n")))
    picked = picked.withColumn("__own", F.coalesce(F.sum("__n").over(Window.orderBy("__src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # `most` rows at most
    placed = ranked_rows(e.join(F.broadcast(picked.select("__src")), F.col("src").eqNullSafe(F.col("__src")), "left_semi"), ["src", "dst"], "__spot")
    rows = placed.join(F.broadcast(picked), F.col("src").eqNullSafe(F.col("__src"))).withColumn("__k", F.col("__before") + F.col("__spot") - F.col("__own"))
    return rows.filter((F.col("__k") % F.col("__s") == 0) & (F.col("__k") / F.col("__s") < most)).select(*edges.columns)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, and both over N - 1 (1 for a single node)."""
    total = nodes.agg(F.count("*").alias("__n"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    rows = nodes.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0).crossJoin(F.broadcast(total))
    share = lambda c: F.when(F.col("__n") == 1, F.lit(1.0)).otherwise(F.col(c) / (F.col("__n") - 1))
    return rows.withColumns({"out_centrality": share("out_degree"), "in_centrality": share("in_degree")}).drop("__n")


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, density over N (N - 1), density_all over N * N; densities null without nodes."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    rows = n.crossJoin(e)
    return rows.withColumns({"density": F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))), "density_all": F.when(F.col("nodes") > 0, F.col("edges") / (F.col("nodes") * F.col("nodes")))})


def type_distribution(edges: DataFrame) -> DataFrame:
    """edge_type, n, weight, share, dominant (the most frequent, ties to the smaller type)."""
    rows = edges.groupBy(F.coalesce("edge_type", F.lit(0)).alias("edge_type")).agg(F.count("*").alias("n"), F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    whole = Window.partitionBy()
    first = F.row_number().over(Window.orderBy(F.desc("n"), "edge_type")) == 1
    return rows.withColumns({"share": F.col("n") / F.sum("n").over(whole), "dominant": first})


def edge_info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n_in, n_out, types (of incoming edges), density = (in + out) / max(1, N - 1), hub if in + out > 2 E / N."""
    totals = nodes.agg(F.count("*").alias("__n")).crossJoin(edges.agg(F.count("*").alias("__e")))
    by_type = edges.groupBy(F.col("dst").alias("id"), F.coalesce("edge_type", F.lit(0)).alias("t")).agg(F.count("*").alias("c"))
    into = by_type.groupBy("id").agg(F.sum("c").alias("n_in"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "c")))).alias("types"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    rows = nodes.select("id").join(into, "id", "left").join(out, "id", "left").withColumns({"n_in": F.coalesce("n_in", F.lit(0)), "n_out": F.coalesce("n_out", F.lit(0))})
    links = F.col("n_in") + F.col("n_out")
    rows = rows.crossJoin(F.broadcast(totals))
    return rows.withColumns({"density": links / F.greatest(F.lit(1), F.col("__n") - 1), "hub": links > F.lit(2.0) * F.col("__e") / F.col("__n")}).drop("__n", "__e")


def classify(segments: DataFrame, importance: str = "importance", group: str = "doc_id") -> DataFrame:
    """tag by priority: TODO or FIXME is TRACK, code or mathematics KEEP, importance under 0.5 / (N + 1e-6) DELETE, else KEEP."""
    n = F.count("*").over(Window.partitionBy(group))
    todo = F.contains("content", F.lit("TODO")) | F.contains("content", F.lit("FIXME"))
    own = F.when(todo, "TRACK").when(F.col("has_code") | F.col("has_math"), "KEEP")  # before the count, which then needs no content
    tag = F.coalesce("__own", F.when(F.col(importance) < 0.5 / (n + 1e-6), "DELETE").otherwise("KEEP"))
    return segments.withColumn("__own", own).withColumn("tag", tag).drop("__own")


def connectivity_bucket(degree: Column) -> Column:
    return F.when(degree == 0, "isolated").when(degree <= 2, "low").when(degree <= 5, "medium").otherwise("high")


def _ranks(damping: float, iterations: int, tol: float | None, directed: bool):
    def run(table: pa.Table) -> pa.Table:
        """One graph: power iteration. Rows with a null dst only name a node."""
        graph = table["graph_id"][0].as_py()
        src = table["src"].to_numpy()
        has = table["dst"].is_valid().to_numpy(zero_copy_only=False)
        dst = table["dst"].fill_null(0).to_numpy()
        w = table["weight"].fill_null(1.0).to_numpy()
        ids, at = np.unique(np.r_[src, dst[has]], return_inverse=True)
        a, b, w = at[: len(src)][has], at[len(src) :], w[has]
        if not directed:
            loops = a == b
            a, b, w = np.r_[a, b[~loops]], np.r_[b, a[~loops]], np.r_[w, w[~loops]]
        n = len(ids)
        out = np.bincount(a, w, n)
        share = np.where(out[a] > 0, w / np.where(out[a] > 0, out[a], 1), 0)
        r = np.full(n, 1 / n)
        for _ in range(iterations):
            new = damping * (np.bincount(b, r[a] * share, n) + r[out == 0].sum() / n) + (1 - damping) / n
            gone = np.abs(new - r).sum()
            r = new
            if tol is not None and gone < n * tol:
                break
        return pa.table([pa.array([graph] * n, table.schema.field("graph_id").type), pa.array(ids), pa.array(r)], ["graph_id", "id", "importance"])

    return run


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tol: float | None = 1e-6, directed: bool = False) -> DataFrame:
    """graph_id, id, importance of each graph (nodes: graph_id, id; edges: graph_id, src, dst, weight), one graph a task.

    Missing weights are 1, dangling mass spreads evenly; null ids, and edges with a null end, are left out; rows that repeat a node are one. For a graph beyond a
    task's memory use ranked or pagerank_shuffled.
    """
    nodes, edges = nodes.filter("graph_id IS NOT NULL AND id IS NOT NULL"), edges.filter("graph_id IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
    named = nodes.select("graph_id", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("weight"))
    return edges.select("graph_id", "src", "dst", "weight").unionByName(named).groupBy("graph_id").applyInArrow(_ranks(damping, iterations, tol, directed), "graph_id long, id long, importance double")


def ranked(nodes: DataFrame, edges: DataFrame, cut, damping: float = 0.85, iterations: int = 20, directed: bool = False, most_rows: int = 1_000_000, chunks: DataFrame | None = None) -> DataFrame:
    """graph_id, id, importance: graphs of up to most_rows nodes and edges one a task, each larger one by products with its packed edges. The edges are packed, unless chunks
    has them so, and written once."""
    edges = edges.filter("graph_id IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").select("graph_id", "src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    chunks = cut(packed.pack(edges) if chunks is None else chunks, "all")
    rows = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).unionByName(chunks.groupBy("graph_id").agg(F.sum("n").alias("n"))).groupBy("graph_id").agg(F.sum("n").alias("n"))
    large = [r.graph_id for r in rows.filter((F.col("n") > most_rows) & F.col("graph_id").isNotNull()).collect()]  # as many as graphs of that size fit the data
    if not large:
        return pagerank(nodes, packed.unpack(chunks), damping, iterations, None, directed)
    other = ~F.col("graph_id").isin(large)
    out = pagerank(nodes.filter(other), packed.unpack(chunks.filter(other)), damping, iterations, None, directed)
    for g in large:
        own = F.col("graph_id") == g
        r = pagerank_packed(nodes.filter(own).select("id"), chunks.filter(own), lambda df, k, g=g: cut(df, f"{g}-{k}"), damping, iterations, directed)
        out = out.unionByName(r.select(F.lit(g).cast("long").alias("graph_id"), "id", "importance"))
    return out


def pagerank_packed(nodes: DataFrame, chunks: DataFrame, cut, damping: float = 0.85, iterations: int = 20, directed: bool = False, most_broadcast: int = 1_000_000) -> DataFrame:
    """id, importance of one large graph from its written chunks of packed edges (`packed.pack`), whose ends are nodes too.

    Up to most_broadcast nodes, which are counted, the driver holds a rank for each node and sends it to the edges, which no round turns into rows; beyond, pagerank_shuffled.
    """
    held = cut(nodes.select(F.col("id").cast("long").alias("id")).filter("id IS NOT NULL").unionByName(packed.ends(chunks)).distinct(), "ends")
    n = held.count()
    if not n or n > most_broadcast:
        return pagerank_shuffled(held, packed.unpack(chunks), cut, damping, iterations, directed, most_broadcast)
    ids = np.sort(packed.column(held, "id"))
    times = packed.product(chunks, ids)
    total = times(np.ones((1, n)), "back" if directed else "both")[0]
    gives = total > 0
    ranks = np.full(n, 1 / n)
    for _ in range(iterations):
        got = times(np.where(gives, ranks / np.where(gives, total, 1), 0)[None], "there" if directed else "both")[0]
        ranks = (1 - damping) / n + damping * (got + ranks[~gives].sum() / n)
    return cut(nodes.sparkSession.createDataFrame(pa.table([ids, ranks], ["id", "importance"])), "ranks")


def pagerank_shuffled(nodes: DataFrame, edges: DataFrame, cut, damping: float = 0.85, iterations: int = 20, directed: bool = False, most_broadcast: int = 1_000_000, written: bool = False) -> DataFrame:
    """id, importance of one large graph; cut(df, k) writes the edges once (unless they are written) and each step's ranks to the shared folder and reads them back.

    Edges stay where they were written: up to most_broadcast nodes, which are counted, ranks go to them by broadcast and only sums by task and node are shuffled;
    beyond, both are joined by shuffle. Null ids, and edges with a null end, are left out; without nodes there are no rows.
    """
    nodes, edges = nodes.select("id").filter("id IS NOT NULL").distinct(), edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    e = edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    e = e if written else cut(e, "edges")
    ways = [("src", "dst", e)] if directed else [("src", "dst", e), ("dst", "src", e.filter("src <> dst"))]

    def summed(value) -> DataFrame:
        """id, s: the sum of each way's values at its node; sums by task come first."""
        parts = [value(rows, a, b).groupBy("id").agg(F.sum("s").alias("s")) for a, b, rows in ways]
        return parts[0] if directed else parts[0].unionByName(parts[1]).groupBy("id").agg(F.sum("s").alias("s"))

    totals = summed(lambda rows, a, b: rows.select(F.col(a).alias("id"), F.col("weight").alias("s"))).withColumnRenamed("s", "total")
    held = cut(nodes.join(totals, "id", "left").na.fill(0.0, ["total"]), "nodes")
    n = max(1, held.count())
    send = F.broadcast if n <= most_broadcast else lambda df: df
    ranks = held.withColumn("importance", F.lit(1.0 / n))
    for k in range(iterations):
        given_by = ranks.filter("total > 0").select("id", (F.col("importance") / F.col("total")).alias("q"))
        got = summed(lambda rows, a, b, q=given_by: rows.join(send(q.withColumnRenamed("id", a)), a).select(F.col(b).alias("id"), (F.col("weight") * F.col("q")).alias("s")))
        lost = ranks.filter("NOT total > 0").agg(F.coalesce(F.sum("importance"), F.lit(0.0)).alias("lost"))
        new = held.join(got, "id", "left").crossJoin(F.broadcast(lost))
        ranks = cut(new.select("id", "total", (F.lit((1 - damping) / n) + damping * (F.coalesce("s", F.lit(0.0)) + F.col("lost") / n)).alias("importance")), k)
    return ranks.select("id", "importance")


def _smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the edges' ends, and for each the smallest id that the edges reach."""
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return ids, ids[label]


def _local_forest(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: each id with the smallest that the task's edges reach from it. At most about 2 * most edges are held."""
    held, n = [], 0

    def stars():
        ids, low = _smallest_reached(*(np.concatenate(c) for c in zip(*held)))
        return low[ids != low], ids[ids != low]

    for batch in batches:
        held.append((batch["src"].to_numpy(zero_copy_only=False), batch["dst"].to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= most:
            held = [stars()]
            n = len(held[0][0])
            if 2 * n > most:  # too many ids to go on with
                yield pa.record_batch([*map(pa.array, held[0])], ["src", "dst"])
                held, n = [], 0
    if held:
        yield pa.record_batch([*map(pa.array, stars())], ["src", "dst"])


def component_labels(edges: DataFrame, cut, most_broadcast: int = 50_000) -> DataFrame:
    """id, comp for every id that an edge (src, dst) names: the smallest id that edges reach, either way. Ids of any ordered type, none null.

    The graph is contracted by rounds: each id goes to the smallest of itself and its neighbours, edges between ids that went to the same vanish, and the
    next round has only the rest, so all rounds together cost a few times the first. After a round that left over three quarters of the edges (a chain in the
    ids' order) the smallest is that by a hash. Edges of long ids are first replaced by stars within their task, which connect the same ids. Up to
    most_broadcast ids, which are counted, go by broadcast and are written in few files; beyond, hubs and large components are split from the other keys,
    so neither meets in a task. cut(df, step) writes a step to the shared folder and reads it back.
    """
    e = edges.select("src", "dst").filter("src <> dst")
    long_ids = all(isinstance(f.dataType, LongType) for f in e.schema)
    rounds, before, hashed = [], math.inf, False
    while True:
        k = len(rounds)
        few = (lambda df: df.coalesce(8)) if before <= 1 << 18 else (lambda df: df)  # edges only become fewer
        if long_ids:  # dense graphs leave their tasks as stars, at most a row for each id that a task has
            e = few(e).mapInArrow(_local_forest, "src long, dst long")
        both = cut(few(e.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).distinct()), f"edges{k}")
        left = both.count()
        if not left and rounds:
            break
        if 4 * left > 3 * before:  # a chain in this order
            hashed = not hashed
        before = left
        place = lambda c, k=k, hashed=hashed: F.struct((F.xxhash64(F.lit(k), c) if hashed else F.lit(0)).alias("first"), F.col(c).alias("id"))
        near = both.groupBy("src").agg(F.min(place("dst")).alias("dst"), F.count("*").alias("deg"))
        near = near.select(F.col("src").alias("id"), F.least(place("src"), "dst")["id"].alias("to"), "deg")
        near = cut(few(near), f"near{k}")
        small = near.count() <= most_broadcast
        rounds.append((near, small))
        if not left:
            break
        once = both.filter("src < dst")
        if small:
            e = once.withColumnRenamed("src", "id").join(F.broadcast(near), "id").select(F.col("to").alias("src"), F.col("dst").alias("id"))
            e = e.join(F.broadcast(near), "id")
        else:
            e = hot_split_join(once.withColumnRenamed("src", "id"), near, "id", "deg", most_broadcast=most_broadcast)
            e = cut(e.select(F.col("to").alias("src"), F.col("dst").alias("id")), f"half{k}")
            e = hot_split_join(e, near, "id", "deg", most_broadcast=most_broadcast)
        e = e.select("src", F.col("to").alias("dst")).filter("src <> dst")
    return _least_of(_unwound(rounds, cut, most_broadcast), rounds[0][1], cut, most_broadcast) if len(rounds) > 1 else rounds[0][0].select("id", F.col("to").alias("comp"))


def _unwound(rounds: list, cut, most_broadcast: int) -> DataFrame:
    """id, last: where each id of the first round went in the last. An id that a later round doesn't have stayed where it was."""
    last = rounds[-1][0].select("id", F.col("to").alias("last"))
    for k, (near, small) in reversed([*enumerate(rounds[:-1])]):
        later = last.withColumnRenamed("id", "to")
        if small:
            found = near.select("id", "to").join(F.broadcast(later), "to", "left")
        else:
            heads = cut(near.groupBy("to").agg(F.count("*").alias("held")).join(later, "to", "left"), f"heads{k}")
            found = hot_split_join(near.select("id", "to"), heads, "to", "held", most_broadcast=most_broadcast)
        last = found.select("id", F.coalesce("last", "to").alias("last"))
        last = last if small else cut(last, f"last{k}")
    return last


def _least_of(groups: DataFrame, small: bool, cut, most_broadcast: int) -> DataFrame:
    """id, comp: the smallest id of each group (id, last)."""
    groups = cut(groups, "groups")
    least = groups.groupBy("last").agg(F.min("id").alias("comp"), F.count("*").alias("held"))
    if small:
        return groups.join(F.broadcast(least), "last").select("id", "comp")
    return hot_split_join(groups, cut(least, "least"), "last", "held", most_broadcast=most_broadcast).select("id", "comp")


def connected_components(nodes: DataFrame, edges: DataFrame, cut, most_broadcast: int = 50_000) -> DataFrame:
    """id, comp: the smallest id that edges among nodes reach, either way; a node without edges is its own. The work is component_labels'."""
    ids = nodes.select("id").distinct()
    labels = component_labels(induced(edges, ids), cut, most_broadcast)
    return ids.join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def _oriented(edges: DataFrame) -> DataFrame:
    """u, v: each undirected edge (src, dst in any order, loops left out) once, from the end of lower degree (ties by id), so that no node
    has more than about the root of twice the edges."""
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return _from_lower_degree(e).select("u", "v", "at")


def _from_lower_degree(e: DataFrame) -> DataFrame:
    """u, v, at, turned and e's further columns, of distinct pairs src < dst: turned where u is dst."""
    deg = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    e = e.join(deg.withColumnsRenamed({"id": "src", "n": "a"}), "src").join(deg.withColumnsRenamed({"id": "dst", "n": "b"}), "dst")
    one, other = (F.struct(F.col(n).alias("n"), F.col(c).alias("i")) for n, c in (("a", "src"), ("b", "dst")))
    e = e.withColumns({"from": F.least(one, other), "at": F.greatest(one, other)}).withColumn("turned", F.col("from.i") != F.col("src"))
    return e.select(F.col("from.i").alias("u"), F.col("at.i").alias("v"), "at", "turned", *[c for c in e.columns if c not in ("src", "dst", "a", "b", "from", "at", "turned")])


def _triangles(e: DataFrame) -> DataFrame:
    """u, v, w in the order of orientation; further columns c of e come as c_uv, c_uw and c_vw."""
    more = [c for c in e.columns if c not in ("u", "v", "at")]
    named = lambda ends: [F.col(c).alias(f"{c}_{ends}") for c in more]
    vw = e.select(F.col("u").alias("v"), F.col("v").alias("w"), *named("vw"))
    wedges = e.select("u", "v", F.col("at").alias("x"), *named("uv")).join(e.select("u", F.col("v").alias("w"), F.col("at").alias("y"), *named("uw")), "u").filter("x < y")
    return wedges.join(vw, ["v", "w"]).select("u", "v", "w", *[f"{c}_{ends}" for ends in ("uv", "uw", "vw") for c in more])


def _sorted(rows: DataFrame, cols: list[str]) -> DataFrame:
    s = F.array_sort(F.array(*cols))
    return rows.select(*[s[i].alias("abcd"[i]) for i in range(len(cols))])


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part that an id is dealt to, by a hash."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % parts


def _pack(parts: int, undirected: bool = False, most: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges as lists: lo, p (its part), q, his (the larger ends, of part q), ways (1: there is an edge lo to hi, 2: one back, 3: both). Loops are left out."""
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            a, b = (np.concatenate(c) for c in zip(*held))
            a, b = a[a != b], b[a != b]
            lo, hi, way = np.minimum(a, b), np.maximum(a, b), (np.full(len(a), 3) if undirected else np.where(a < b, 1, 2)).astype(np.int8)
            q = _part(hi, parts)
            order = np.lexsort((hi, q, lo))
            lo, hi, q, way = lo[order], hi[order], q[order], way[order]
            firsts = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])][: len(lo)])
            way = np.bitwise_or.reduceat(way, firsts) if len(lo) else way
            lo, hi, q = lo[firsts], hi[firsts], q[firsts]
            rows = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (q[1:] != q[:-1])][: len(lo)])
            ends = pa.array(np.r_[rows, len(lo)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (hi, way)]
            return pa.record_batch([pa.array(lo[rows]), pa.array(_part(lo[rows], parts)), pa.array(q[rows]), *lists], ["lo", "p", "q", "his", "ways"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(2)))
            n += batch.num_rows
            if n >= most:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    return run


class _Cell:
    """The edges of a cell: ids in the order of their degree there, edges (u, v), u before v, sorted, and the ways of each (1: u to v, 2: v to u)."""

    def __init__(self, table: pa.Table):
        lists = table["his"].combine_chunks()
        lo, hi = np.repeat(table["lo"].to_numpy(), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        ids, at = np.unique(np.r_[lo, hi], return_inverse=True)
        self.n = len(ids)
        rank = np.empty(self.n, np.int64)
        order = np.argsort(np.bincount(at, minlength=self.n), kind="stable")
        rank[order] = np.arange(self.n)
        self.ids = ids[order]
        a, b = rank[at[: len(lo)]], rank[at[len(lo) :]]
        way = table["ways"].combine_chunks().flatten().to_numpy()
        way = np.where(a < b, way, (way >> 1) | ((way & 1) << 1))
        key = np.minimum(a, b) * self.n + np.maximum(a, b)
        order = np.argsort(key, kind="stable")
        self.key, firsts = np.unique(key[order], return_index=True)
        self.way = np.bitwise_or.reduceat(way[order], firsts)
        self.u, self.v = np.divmod(self.key, self.n)
        self.start = np.searchsorted(self.u, np.arange(self.n + 1))

    def _after(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each edge (x, y) every edge (y, z): the place in `edges`, and the edge (y, z)."""
        first = self.start[self.v[edges]]
        count = self.start[self.v[edges] + 1] - first
        of = np.repeat(np.arange(len(edges)), count)
        return of, np.arange(len(of)) + np.repeat(first - np.cumsum(count) + count, count)

    def triangles(self, most_marks: int = 1 << 23, most_wedges: int = 1 << 21):
        """Edges uv, uw and vw of triangles u, v, w in order, and the marks of their first nodes' edges (edge (u, z) + 1 at (u - base) * n + z). As many first nodes at once
        as give about most_wedges wedges."""
        out = np.diff(self.start)
        before = np.r_[0, np.cumsum(out[self.v])][self.start]
        mark, at, rows = np.zeros(max(most_marks, self.n), np.int32), 0, max(1, most_marks // max(1, self.n))
        while at < self.n:
            end = min(at + rows, max(at + 1, int(np.searchsorted(before, before[at] + most_wedges, "right")) - 1), self.n)
            uv = np.arange(self.start[at], self.start[end])
            marked = (self.u[uv] - at) * self.n + self.v[uv]
            mark[marked] = uv + 1
            of, vw = self._after(uv)
            uw = mark[(self.u[uv[of]] - at) * self.n + self.v[vw]]
            hit = np.flatnonzero(uw)
            yield uv[of[hit]], uw[hit] - 1, vw[hit], mark, at
            mark[marked] = 0
            at = end

    def cliques(self, size: int, most_wedges: int = 1 << 21):
        """Nodes in order, an array for each corner, and for size 3 the edges uv, uw, vw."""
        for uv, uw, vw, mark, at in self.triangles(most_wedges=most_wedges):
            if size == 3:
                yield (self.u[uv], self.v[uv], self.v[vw]), (uv, uw, vw)
                continue
            longer = np.r_[0, np.cumsum(np.diff(self.start)[self.v[vw]])]
            k = 0
            while k < len(vw):
                end = max(k + 1, int(np.searchsorted(longer, longer[k] + most_wedges, "right")) - 1)
                of, wx = self._after(vw[k:end])
                of += k
                hit = mark[(self.u[uv[of]] - at) * self.n + self.v[wx]] > 0
                of, wx = of[hit], wx[hit]
                key = self.v[uv[of]] * self.n + self.v[wx]
                hit = self.key[np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)] == key
                of, wx = of[hit], wx[hit]
                yield (self.u[uv[of]], self.v[uv[of]], self.v[vw[of]], self.v[wx]), None
                k = end


def _found(parts: int, size: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's cliques that have their corners in just its parts, or each node's closed pairs of out-neighbours in its triangles."""
        table = pa.Table.from_batches(batches)
        code, want = table["cell"][0].as_py(), []
        for _ in range(size):
            code, part = divmod(code, parts)
            want.insert(0, part)
        cell = _Cell(table)
        del table
        part, closed = _part(cell.ids, parts), np.zeros(cell.n, np.int64)
        for nodes, edges in cell.cliques(size):
            own = slice(None)
            if len(set(want)) < size:
                own = (np.sort(np.stack([part[x] for x in nodes]), axis=0) == np.array(want)[:, None]).all(axis=0)
            nodes = [x[own] for x in nodes]
            if counted:
                uv, uw, vw = (cell.way[x[own]] for x in edges)
                there, back, either = (lambda w: w & 1), (lambda w: w >> 1), (lambda w: (w & 1) + (w >> 1))
                for x, n in zip(nodes, (there(uv) * there(uw) * either(vw), back(uv) * there(vw) * either(uw), back(uw) * back(vw) * either(uv))):
                    np.add.at(closed, x, n)
            elif len(nodes[0]):
                found = np.sort(np.stack([cell.ids[x] for x in nodes]), axis=0)
                yield pa.record_batch([pa.array(x) for x in found], list("abcd"[:size]))
        if counted:
            has = np.flatnonzero(closed)
            yield pa.record_batch([pa.array(cell.ids[has]), pa.array(closed[has])], ["id", "n"])

    return run


def _by_cells(edges: DataFrame, size: int, counted: bool = False, undirected: bool = False, most_edges: int = 1 << 21, least_parts: int = 4) -> DataFrame:
    """Cliques of `size` (3 or 4) of a written table's edges (two columns of longs), or (id, n) of triangles.

    Nodes are dealt to parts; a cell is a multiset of `size` parts, and gets the edges between them, as lists. So each clique is found in just one cell, a cell holds about most_edges edges, and an edge
    is sent once for each part (for four corners, each pair of parts); wedges never leave a task.
    """
    n = edges.count()
    corners = size * (size - 1)
    parts = max(1 if n <= 50_000 else least_parts, int(np.ceil(np.sqrt(corners * n / most_edges))))
    rest = F.explode(F.array(*[F.array(*map(F.lit, c)) for c in combinations_with_replacement(range(parts), size - 2)]))
    rows = edges.mapInArrow(_pack(parts, undirected), "lo long, p long, q long, his array<long>, ways array<byte>").withColumn("rest", rest)
    key = F.aggregate(F.array_sort(F.concat(F.array("p", "q"), F.transform("rest", lambda x: x.cast("long")))), F.lit(0).cast("long"), lambda a, x: a * parts + x)
    schema = "id long, n long" if counted else ", ".join(f"{c} long" for c in "abcd"[:size])
    return rows.select(key.alias("cell"), "lo", "his", "ways").groupBy("cell").applyInArrow(_found(parts, size, counted), schema)


def _all_longs(edges: DataFrame) -> bool:
    return all(f.dataType.typeName() in ("byte", "short", "integer", "long") for f in edges.schema)


def _cliques(edges: DataFrame, size: int, written: bool) -> DataFrame:
    kind = edges.schema[0].dataType
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    e = e if written else cutter(edges.sparkSession, "cliques")(e, "edges")
    return _by_cells(e.filter("src IS NOT NULL AND dst IS NOT NULL"), size).select(*[F.col(c).cast(kind).alias(c) for c in "abcd"[:size]])


def triangles(edges: DataFrame, written: bool = False) -> DataFrame:
    """a < b < c of the undirected edges. Those of whole numbers are written once (unless they are written) and go by cells of parts; others by joins, with wedges at the end of lowest degree only."""
    edges = edges.select("src", "dst")
    return _cliques(edges, 3, written) if _all_longs(edges) else _sorted(_triangles(_oriented(edges)), ["u", "v", "w"])


def four_cliques(edges: DataFrame, written: bool = False) -> DataFrame:
    """a < b < c < d; as triangles, by joins from triangles and the oriented neighbours of their first node."""
    edges = edges.select("src", "dst")
    if _all_longs(edges):
        return _cliques(edges, 4, written)
    e = _oriented(edges)
    ends = lambda a, b: e.select(F.col("u").alias(a), F.col("v").alias(b))
    t = _triangles(e).join(ends("u", "x"), "u").filter("x <> v AND x <> w")
    t = t.join(ends("v", "x"), ["v", "x"], "left_semi").join(ends("w", "x"), ["w", "x"], "left_semi")
    return _sorted(t, ["u", "v", "w", "x"])


def clustering(cells: DataFrame, group: str | None = None, undirected: bool = False) -> DataFrame:
    """id, k, coefficient of nodes with at least two out-neighbours (a loop counts as a neighbour): directed edges among neighbours over k (k - 1).

    Counted on the triangles of the undirected edges, so a hub's neighbours don't meet pair by pair. Cells (i, j) should be distinct. With group, a long column of
    cells, each group by itself: ids are then structs of group and id. Without, cells of whole numbers are written once and triangles counted by cells of parts, so that
    wedges aren't shuffled. undirected: cells name each edge once and stand for both ways.
    """
    if not group and _all_longs(cells.select("i", "j")):
        return _clustering_by_cells(cells, undirected)
    if undirected:
        cells = cells.select(*filter(None, [group]), "i", "j").unionByName(cells.filter("i <> j").select(*filter(None, [group]), F.col("j").alias("i"), F.col("i").alias("j")))
    at = lambda c: F.struct(group, F.col(c).alias("id")) if group else F.col(c)
    rows = cells.select(at("i").alias("i"), at("j").alias("j"))
    k = rows.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("k")).filter("k >= 2")
    pairs = rows.filter("i <> j").select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), (F.col("i") < F.col("j")).cast("int").alias("up")).groupBy("src", "dst").agg(F.max("up").alias("up"), F.max(1 - F.col("up")).alias("down"))
    e = _from_lower_degree(pairs)
    # there: the edge from u to v is in the cells, back: that from v to u
    e = e.select("u", "v", "at", F.when(F.col("turned"), F.col("down")).otherwise(F.col("up")).alias("there"), F.when(F.col("turned"), F.col("up")).otherwise(F.col("down")).alias("back"))
    t = _triangles(e)
    way = lambda x, y: F.col(f"there_{x}{y}") if x < y else F.col(f"back_{y}{x}")
    each = [F.struct(F.col(x).alias("id"), (way(x, y) * way(x, z) * (way(y, z) + way(z, y))).alias("n")) for x, y, z in ("uvw", "vuw", "wuv")]
    closed = t.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    loops = rows.filter("i = j").select(F.col("i").alias("id"))
    out = rows.filter("i <> j").join(loops.withColumnRenamed("id", "i"), "i", "left_semi")
    back = out.join(rows.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("n")), ["i", "j"], "left")
    closed = closed.unionByName(back.select(F.col("i").alias("id"), (1 + F.coalesce("n", F.lit(0))).alias("n")))
    return k.join(closed.groupBy("id").agg(F.sum("n").alias("closed")), "id", "left").select("id", "k", (F.coalesce("closed", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).alias("coefficient"))


def _clustering_by_cells(cells: DataFrame, undirected: bool) -> DataFrame:
    kind = cells.schema["i"].dataType
    cells = cutter(cells.sparkSession, "clustering")(cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")), "cells")
    back = cells.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"))
    rows = cells.unionByName(back) if undirected else cells
    k = cells.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("k"))
    if undirected:
        k = k.unionByName(back.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("k"))).groupBy("id").agg(F.sum("k").alias("k"))
    closed = _by_cells(cells.filter("i IS NOT NULL AND j IS NOT NULL"), 3, counted=True, undirected=undirected)
    loops = cells.filter("i = j").select("i").distinct()
    if loops.limit(1).count():
        out = rows.filter("i <> j").join(loops, "i", "left_semi")
        met = out.join(rows.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("n")), ["i", "j"], "left")
        closed = closed.unionByName(met.select(F.col("i").alias("id"), (1 + F.coalesce("n", F.lit(0))).cast("long").alias("n")))
    out = k.filter("k >= 2").join(closed.groupBy("id").agg(F.sum("n").alias("closed")), "id", "left")
    return out.select(F.col("id").cast(kind).alias("id"), "k", (F.coalesce("closed", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).alias("coefficient"))


def simplices(cells: DataFrame, n: int, threshold: float = 0.3, group: str | None = None) -> DataFrame:
    """With group, a column of cells, each group by itself: group, dim, members, its vertices being those that have cells; i and j below n. Else
    dim, members: vertices, edges and cliques of the symmetric mean over the threshold, both to 7 decimals, so that the order of a sum doesn't decide. Cliques of 3 and 4 only below n: none at n = 3, triangles alone at n = 4."""
    if group:
        key = F.col(group).cast("long") * n
        cells = cells.select((key + F.col("i")).alias("i"), (key + F.col("j")).alias("j"), "w")
    sym = cells.unionByName(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))
    e = sym.filter((F.round("w", 7) > round(threshold, 7)) & (F.col("i") < F.col("j"))).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    spark = cells.sparkSession
    vertices = sym.select(F.col("i").alias("id")).distinct() if group else spark.range(n)
    out = vertices.select(F.lit(0).alias("dim"), F.array(F.col("id").cast("long")).alias("members"))
    out = out.unionByName(e.select(F.lit(1).alias("dim"), F.array(F.col("src").cast("long"), F.col("dst").cast("long")).alias("members")))
    for k, found in ((3, triangles), (4, four_cliques)):
        if k < min(n, 5):
            cols = [F.col(c).cast("long") for c in "abcd"[:k]]
            out = out.unionByName(found(e).select(F.lit(k - 1).alias("dim"), F.array(*cols).alias("members")))
    if group:
        out = out.select(F.floor(F.element_at("members", 1) / n).alias(group), "dim", F.transform("members", lambda x: x % n).alias("members"))
    return out


def preorder(segments: DataFrame, tag: str = "KEEP") -> DataFrame:
    """doc_id, k, seg_id, content: tree pre-order of the segments with the tag."""
    kept = segments.filter(F.col("tag") == tag)
    return kept.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seg_id")) - 1).alias("k"), "seg_id", "content")


def preorder_edges(nodes: DataFrame, edges: DataFrame, root: str = "0") -> DataFrame:
    """doc_id, k, id: depth-first pre-order from the root over all edges, a node's links in their order (edges: doc_id, src, dst, ord). One
    document a task; nodes that the root doesn't reach are left out."""

    def walk(key: tuple, nodes_of: pd.DataFrame, edges_of: pd.DataFrame) -> pd.DataFrame:
        links: dict = {}
        for r in edges_of.sort_values(["ord", "dst"]).itertuples():
            links.setdefault(r.src, []).append(r.dst)
        known, seen, stack, out = set(nodes_of.id), set(), [root], []
        while stack:
            node = stack.pop()
            if node in seen or node not in known:
                continue
            seen.add(node)
            out.append(node)
            stack += reversed(links.get(node, []))
        return pd.DataFrame({"doc_id": [key[0]] * len(out), "k": range(len(out)), "id": out})

    return nodes.select("doc_id", "id").groupBy("doc_id").cogroup(edges.select(F.col("doc_id").alias("doc"), "src", "dst", "ord").groupBy("doc")).applyInPandas(walk, "doc_id long, k long, id string")


def gap_clusters(nodes: DataFrame, edges: DataFrame, cut, least: float = 0.6) -> DataFrame:
    """cluster, id: components of more than one among nodes (id, cohesion) over least, a row for each member."""
    kept = nodes.filter(F.col("cohesion") > least).select("id")
    comps = connected_components(kept, edges, cut)
    sizes = comps.groupBy("comp").agg(F.count("*").alias("n")).filter("n > 1")
    return comps.join(sizes, "comp").select(F.col("comp").alias("cluster"), "id")


def gap_hubs(nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """id, strength, cohesion of the nodes whose strength is over least."""
    return nodes.filter(F.col("strength") > least).select("id", "strength", "cohesion")


def cross_level_agreement(edges: DataFrame) -> DataFrame:
    """agreement: mean of the edges' agreement, which is 0 where it isn't set; null without edges."""
    return edges.agg(F.avg(F.coalesce("agreement", F.lit(0.0))).alias("agreement"))


def pattern_hubs(cells: DataFrame, n: int) -> DataFrame:
    """id: nodes whose row or column sum is over mean plus deviation of all n * n cells."""
    stats = dense_threshold(cells, n)
    sums = cells.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("o")).join(cells.groupBy(F.col("j").alias("id")).agg(F.sum("w").alias("n")), "id", "full").na.fill(0.0)
    return sums.crossJoin(F.broadcast(stats)).filter("o > threshold OR n > threshold").select("id")


def node_patterns(cells: DataFrame, sizes: DataFrame, cut) -> DataFrame:
    """window_idx, nodes, mean, variance, hubs, clustering, components, largest, density of each window's cells (window_idx, i, j, w).

    sizes: window_idx, n. All n * n cells count, absent ones as 0. Hubs have a row or column sum over mean plus deviation; clustering is the mean
    coefficient of nodes with two neighbours or more (0 without any, or below three nodes); components are of the cells over that same threshold,
    either way, single nodes counted.
    """
    c = cells.join(sizes, "window_idx")
    area = F.max("n").cast("double") * F.max("n")
    stats = c.groupBy("window_idx").agg(F.max("n").alias("nodes"), (F.sum("w") / area).alias("mean"), (F.sum(F.col("w") * F.col("w")) / area).alias("sq"), (F.count_if(F.col("w") > 0) / area).alias("density"))
    stats = sizes.join(stats, "window_idx", "left").withColumn("nodes", F.col("n")).na.fill(0.0, ["mean", "sq", "density"])
    stats = stats.withColumn("variance", F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0))).withColumn("threshold", F.col("mean") + F.sqrt("variance"))
    sums = [cells.groupBy("window_idx", F.col(x).alias("id")).agg(F.sum("w").alias("s")) for x in "ij"]
    over = sums[0].unionByName(sums[1]).join(stats.select("window_idx", "threshold"), "window_idx").filter("s > threshold")
    hubs = over.groupBy("window_idx").agg(F.count_distinct("id").alias("hubs"))
    coefficients = clustering(cells.filter("w > 0"), "window_idx").select("id.window_idx", "coefficient")
    mean = coefficients.join(sizes.filter("n >= 3"), "window_idx", "left_semi").groupBy("window_idx").agg(F.avg("coefficient").alias("clustering"))
    strong = cells.join(stats.select("window_idx", "threshold"), "window_idx").filter("w > threshold")
    node = lambda c: F.struct("window_idx", F.col(c).cast("long").alias("i"))
    every = sizes.select("window_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("i")).select(node("i").alias("id"))
    comps = connected_components(every, strong.select(node("i").alias("src"), node("j").alias("dst")), cut)
    parts = comps.groupBy("comp").agg(F.count("*").alias("n")).groupBy("comp.window_idx").agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    out = stats.join(hubs, "window_idx", "left").join(mean, "window_idx", "left").join(parts, "window_idx", "left").na.fill(0, ["hubs", "components", "largest"]).na.fill(0.0, ["clustering"])
    return out.select("window_idx", "nodes", "mean", "variance", "hubs", "clustering", "components", "largest", "density")


def top_by_incoming_type(edges: DataFrame, most: int = 3) -> DataFrame:
    """edge_type, rank, id, n: the nodes with most incoming edges of each type."""
    n = edges.groupBy(F.coalesce("edge_type", F.lit(0)).alias("edge_type"), F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("edge_type").orderBy(F.desc("n"), "id"))).filter(F.col("rank") <= most)


def pipeline_ratios(segments: DataFrame, edges: DataFrame, texts: DataFrame, cohesive: float = 0.5) -> DataFrame:
    """doc_id, kept_ratio, compression (length of the new text over that of the old), edge_density (E / N^2), typed_edges, cohesive_segments (cohesion over cohesive;
    0 where segments have no such column).

    segments: doc_id, tag, cohesion; texts: doc_id, before, after.
    """
    cohesion = F.coalesce("cohesion", F.lit(0.0)) if "cohesion" in segments.columns else F.lit(0.0)
    s = segments.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg((F.col("tag") == "KEEP").cast("double")).alias("kept_ratio"), F.count_if(cohesion > cohesive).alias("cohesive_segments"))
    e = edges.groupBy("doc_id").agg(F.count("*").alias("e"), F.sum((F.coalesce("edge_type", F.lit(0)) != 0).cast("long")).alias("typed_edges"))
    rows = s.join(e, "doc_id", "left").na.fill(0, ["e", "typed_edges"]).join(texts, "doc_id")
    return rows.select("doc_id", "kept_ratio", (F.length("after") / F.greatest(F.length("before"), F.lit(1))).alias("compression"), (F.col("e") / (F.col("n") * F.col("n"))).alias("edge_density"), "typed_edges", "cohesive_segments")

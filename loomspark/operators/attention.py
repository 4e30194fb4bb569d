"""Attention analytics over cells attn(window_idx, layer, head, i, j, w); cells that are absent count as 0 in dense statistics.

Where a function says nothing else: empty tables give empty tables (summaries over everything one row), and a null weight is an absent cell for sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

# fixed values
BIAS = {"BOUNDARY": -0.5, "SPEAKER_BOUNDARY": -1.0, "REFERENCE": 0.3, "TOPIC_EVOLUTION": 0.2}
EPS = 1e-10
_DECIMALS = Context(prec=400, rounding=ROUND_HALF_UP)


def layer_mean(attn: DataFrame, layers: int) -> DataFrame:
    """window_idx, head, i, j, w: mean over layers, later ones weighing more (1 + layer / layers)."""
    wt = 1 + F.col("layer") / F.lit(layers)
    return attn.groupBy("window_idx", "head", "i", "j").agg((F.sum(F.col("w") * wt) / F.sum(wt)).alias("w"))


def flow(cells: DataFrame, heads: int) -> DataFrame:
    """window_idx, i, flow: attention to earlier positions, mean over heads; 0 at the first."""
    back = F.sum(F.when(F.col("j") < F.col("i"), F.col("w")).otherwise(0.0)) / heads
    return cells.groupBy("window_idx", "i").agg(back.alias("flow"))


def _by_place() -> Window:
    return Window.partitionBy("window_idx").orderBy("i")


def drops(flows: DataFrame, threshold: float = 0.3) -> DataFrame:
    """window_idx, position, strength, type: where flow falls under 1 - threshold of the mean of the three before it."""
    n = F.count("*").over(Window.partitionBy("window_idx"))
    prev = F.avg("flow").over(_by_place().rowsBetween(-3, -1))
    rows = flows.withColumns({"n": n, "prev": prev}).filter("i >= 3 AND i <= n - 2 AND prev > 0").withColumn("ratio", F.col("flow") / F.col("prev"))
    return rows.filter(F.col("ratio") < 1 - threshold).select("window_idx", F.col("i").alias("position"), (1 - F.col("ratio")).alias("strength"), F.lit("attention_drop").alias("type"))


def peaks(flows: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The same where flow exceeds the mean of the five around it by the threshold."""
    n = F.count("*").over(Window.partitionBy("window_idx"))
    near = F.avg("flow").over(_by_place().rowsBetween(-2, 2))
    rows = flows.withColumns({"n": n, "near": near}).filter("i >= 1 AND i <= n - 4 AND near > 0")
    return rows.filter(F.col("flow") > F.col("near") * (1 + threshold)).select("window_idx", F.col("i").alias("position"), (F.col("flow") / F.col("near") - 1).alias("strength"), F.lit("attention_peak").alias("type"))


def consolidate(boundaries: DataFrame, least: float = 0.2, keys: list[str] | None = None) -> DataFrame:
    """position (or the given keys), strength (mean), type (a drop if any is), n, of those over least."""
    rows = boundaries.groupBy(*(keys or ["position"])).agg(F.avg("strength").alias("strength"), F.min("type").alias("type"), F.count("*").alias("n"))
    return rows.filter(F.col("strength") > least)


def greedy_segments(boundaries: DataFrame, group: list[str], least: int = 50, groups: DataFrame | None = None) -> DataFrame:
    """group, ord, start, end, confidence: a segment closes at a boundary at least `least` after its start; the last is open (end -1, confidence .8).

    Groups that `groups` names and that have no boundary are one open segment of confidence 1.
    """
    rows = boundaries.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col("position").cast("long").alias("p"), "strength"))).alias("bs"))
    seg = "array<struct<start:bigint,end:bigint,confidence:double>>"
    start = F.struct(F.array().cast(seg).alias("out"), F.lit(0).cast("long").alias("s"))

    def step(a: Column, b: Column) -> Column:
        made = F.struct(a["s"].alias("start"), b["p"].alias("end"), b["strength"].alias("confidence"))
        return F.when(b["p"] - a["s"] >= least, F.struct(F.concat(a["out"], F.array(made)).alias("out"), b["p"].alias("s"))).otherwise(a)

    last = lambda a: F.concat(a["out"], F.array(F.struct(a["s"].alias("start"), F.lit(-1).cast("long").alias("end"), F.lit(0.8).alias("confidence"))))
    out = rows.select(*group, F.posexplode(F.aggregate("bs", start, step, last)).alias("ord", "x")).select(*group, "ord", "x.*")
    if groups is None:
        return out
    whole = groups.select(*group).distinct().join(rows.select(*group), group, "left_anti")
    return out.unionByName(whole.select(*group, F.lit(0).alias("ord"), F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"), F.lit(1.0).alias("confidence")))


def entropy(cells: DataFrame, n: DataFrame, group: list[str]) -> DataFrame:
    """group, entropy: rows' entropy with EPS added to every cell (absent ones too), mean over rows and then heads.

    n: window_idx, n (positions). group holds window_idx and not head.
    """
    rows = cells.groupBy(*group, "head", "i").agg(F.sum("w").alias("s"), F.count("*").alias("c"), F.collect_list("w").alias("ws")).join(n, "window_idx")
    total = F.col("s") + F.col("n") * EPS
    plogp = lambda w: (w + EPS) / total * F.ln((w + EPS) / total)
    h = -(F.aggregate("ws", F.lit(0.0), lambda a, w: a + plogp(w)) + (F.col("n") - F.col("c")) * plogp(F.lit(0.0)))
    heads = rows.withColumn("h", h).groupBy(*group, "head").agg((F.sum("h") / F.max("n")).alias("h"))
    return heads.groupBy(*group).agg(F.avg("h").alias("entropy"))


def dominant_paths(cells: DataFrame, heads: int, k: int = 3) -> DataFrame:
    """window_idx, rank, i, j, w: the k largest cells of the mean over heads."""
    mean = cells.groupBy("window_idx", "i", "j").agg(F.round(F.sum("w") / heads, 9).alias("w"))
    rank = F.row_number().over(Window.partitionBy("window_idx").orderBy(F.desc("w"), "i", "j"))
    return mean.withColumn("rank", rank).filter(F.col("rank") <= k)


def coherence(entropies: DataFrame) -> DataFrame:
    """window_idx, coherence: 1 / (1 + population variance of the layers' entropies); 1 for a single layer."""
    return entropies.groupBy("window_idx").agg((1 / (1 + F.coalesce(F.var_pop("entropy"), F.lit(0.0)))).alias("coherence"))


def window_patterns(attn: DataFrame, sizes: DataFrame, heads: int, layers: int) -> DataFrame:
    """window_idx, entropies (of the layers, in order), coherence, paths (the strongest cells of the layers' mean: i, j, w)."""
    e = entropy(attn, sizes, ["window_idx", "layer"])
    per = e.groupBy("window_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "entropy"))), lambda r: r["entropy"]).alias("entropies"))
    paths = dominant_paths(layer_mean(attn, layers), heads).groupBy("window_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "i", "j", "w"))), lambda r: F.struct(r["i"].alias("i"), r["j"].alias("j"), r["w"].alias("w"))).alias("paths"))
    return per.join(coherence(e), "window_idx").join(paths, "window_idx")


def views(attn: DataFrame) -> DataFrame:
    """window_idx, layer, head, i, j, w: means over layers and heads, over layers, and over heads in one pass of grouping sets."""
    keys = ["window_idx", "layer", "head", "i", "j"]
    sets = [[F.col(c) for c in keys if c not in out] for out in (("layer", "head"), ("layer",), ("head",))]
    return attn.groupingSets(sets, *keys).agg(F.avg("w").alias("w"))


def picked_layers(attn: DataFrame) -> DataFrame:
    """view (first, middle, last), window_idx, head, i, j, w of those of a window's layers; the middle one is number n // 2. A layer may be several."""
    ids = attn.select("window_idx", "layer").distinct().groupBy("window_idx").agg(F.array_sort(F.collect_list("layer")).alias("ls"))
    at = lambda name, k: F.struct(F.lit(name).alias("view"), F.element_at("ls", k).alias("layer"))
    chosen = ids.select("window_idx", F.explode(F.array(at("first", F.lit(1)), at("middle", (F.floor(F.size("ls") / 2) + 1).cast("int")), at("last", F.lit(-1)))).alias("p")).select("window_idx", "p.*")
    return attn.join(chosen, ["window_idx", "layer"]).select("view", "window_idx", "head", "i", "j", "w")


def cohesion(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """window_idx, seg, internal, external, cohesion of segments of at least two tokens.

    cells: window_idx, i, j, w; mapping: window_idx, tok, seg. Means are over all cells of the block, absent ones 0. Cohesion is internal over
    external + 1e-6, or internal alone without tokens outside.
    """
    a, b = mapping.select("window_idx", F.col("tok").alias("i"), F.col("seg").alias("si")), mapping.select("window_idx", F.col("tok").alias("j"), F.col("seg").alias("sj"))
    sums = cells.join(a, ["window_idx", "i"]).join(b, ["window_idx", "j"]).groupBy("window_idx", F.col("si").alias("seg"))
    inner = F.sum(F.when(F.col("si") == F.col("sj"), F.col("w")).otherwise(0.0))
    sums = sums.agg(inner.alias("inner"), (F.sum("w") - inner).alias("outer"))
    sizes = mapping.groupBy("window_idx", "seg").agg(F.count("*").alias("k")).withColumn("n", F.sum("k").over(Window.partitionBy("window_idx"))).filter("k >= 2")
    rows = sizes.join(sums, ["window_idx", "seg"], "left").na.fill(0.0, ["inner", "outer"])
    rows = rows.withColumns({"internal": F.col("inner") / (F.col("k") * F.col("k")), "external": F.when(F.col("n") > F.col("k"), F.col("outer") / (F.col("k") * (F.col("n") - F.col("k"))))})
    return rows.select("window_idx", "seg", "internal", "external", F.when(F.col("external").isNull(), F.col("internal")).otherwise(F.col("internal") / (F.col("external") + 1e-6)).alias("cohesion"))


def cross_level(token_node: DataFrame) -> DataFrame:
    """window_idx, node, tokens (that attend to it most), mean_max: from cells window_idx, tok, node, w; ties to the smaller node."""
    best = token_node.groupBy("window_idx", "tok").agg(F.max(F.struct("w", (-F.col("node")).alias("neg"))).alias("b"))
    return best.groupBy("window_idx", (-F.col("b.neg")).alias("node")).agg(F.count("*").alias("tokens"), F.avg("b.w").alias("mean_max"))


def cohesion_summary(cohesions: DataFrame) -> DataFrame:
    """window_idx, overall, variance, least, most of the segments' cohesion; windows without segments of two tokens have no row."""
    c = F.col("cohesion")
    return cohesions.groupBy("window_idx").agg(F.avg(c).alias("overall"), F.var_pop(c).alias("variance"), F.min(c).alias("least"), F.max(c).alias("most"))


def cross_summary(token_node: DataFrame, mapping: DataFrame) -> DataFrame:
    """window_idx, mean, most, consistency, strength of cells (window_idx, tok, node, w), which should be all tokens by all nodes.

    Consistency is the mean attention of a node's own tokens (window_idx, tok, seg) to it, summed over nodes of two tokens or more, over the number of nodes; strength the mean of
    each token's largest cell.
    """
    per = token_node.groupBy("window_idx", "tok").agg(F.max("w").alias("m")).groupBy("window_idx").agg(F.avg("m").alias("strength"))
    stats = token_node.groupBy("window_idx").agg(F.avg("w").alias("mean"), F.max("w").alias("most"), F.count_distinct("node").alias("nodes"))
    own = token_node.join(mapping.select("window_idx", "tok", F.col("seg").alias("node")), ["window_idx", "tok", "node"])
    own = own.groupBy("window_idx", "node").agg(F.avg("w").alias("a"), F.count("*").alias("c")).filter("c > 1").groupBy("window_idx").agg(F.sum("a").alias("a"))
    rows = stats.join(per, "window_idx").join(own, "window_idx", "left")
    return rows.select("window_idx", "mean", "most", (F.coalesce("a", F.lit(0.0)) / F.col("nodes")).alias("consistency"), "strength")


def dual_results(patterns: DataFrame, cross: DataFrame, cohesions: DataFrame, boundaries: DataFrame) -> DataFrame:
    """One row over all windows: means of the node patterns, cross-level patterns and window cohesions, sums of hubs, and the flags of what was there.

    patterns: of graph.node_patterns; cross: of cross_summary; cohesions: of cohesion_summary; boundaries: of merge_near. Means of nothing are null.
    """
    o = F.col("overall")
    a = patterns.agg(F.avg("mean").alias("mean_node_attention"), F.avg("clustering").alias("mean_clustering"), F.avg("density").alias("mean_density"), F.coalesce(F.sum("hubs"), F.lit(0)).alias("total_hubs"), F.avg("largest").alias("avg_component_size"), F.count("*").alias("windows_processed"))
    b = cross.agg(F.avg("mean").alias("mean_cross_attention"), F.avg("consistency").alias("mean_consistency"), F.avg("strength").alias("mean_strength"), (F.count("*") > 0).alias("has_cross_attention"))
    c = cohesions.agg(F.avg(o).alias("mean_cohesion"), F.var_pop(o).alias("cohesion_variance"), F.min(o).alias("min_cohesion"), F.max(o).alias("max_cohesion"))
    d = boundaries.agg(F.count("*").alias("dual_boundary_count"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).withColumn("has_node_attention", F.col("windows_processed") > 0)


def transitions(mapping: DataFrame) -> DataFrame:
    """window_idx, position, from_seg, to_seg: where a token's segment differs from the one before."""
    prev = F.lag("seg").over(Window.partitionBy("window_idx").orderBy("tok"))
    return mapping.withColumn("p", prev).filter("p IS NOT NULL AND p <> seg").select("window_idx", F.col("tok").alias("position"), F.col("p").alias("from_seg"), F.col("seg").alias("to_seg"))


def weak_links(node_cells: DataFrame, mapping: DataFrame, n: DataFrame) -> DataFrame:
    """window_idx, seg_a < seg_b, position, strength: pairs whose both directions lie under mean minus deviation over all n * n cells."""
    stats = node_cells.join(n, "window_idx").groupBy("window_idx").agg((F.sum("w") / F.max(F.col("n") * F.col("n"))).alias("mean"), (F.sum(F.col("w") * F.col("w")) / F.max(F.col("n") * F.col("n"))).alias("sq"))
    stats = stats.select("window_idx", (F.col("mean") - F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))).alias("low"))
    ab = node_cells.select("window_idx", F.col("i").alias("seg_a"), F.col("j").alias("seg_b"), F.col("w").alias("ab")).filter("seg_a < seg_b")
    ba = node_cells.select("window_idx", F.col("j").alias("seg_a"), F.col("i").alias("seg_b"), F.col("w").alias("ba"))
    ends = mapping.groupBy("window_idx", "seg").agg(F.min("tok").alias("first"), F.max("tok").alias("last"))
    rows = ab.join(ba, ["window_idx", "seg_a", "seg_b"]).join(stats, "window_idx").filter("ab < low AND ba < low")
    rows = rows.join(ends.select("window_idx", F.col("seg").alias("seg_a"), "last"), ["window_idx", "seg_a"]).join(ends.select("window_idx", F.col("seg").alias("seg_b"), "first"), ["window_idx", "seg_b"])
    return rows.select("window_idx", "seg_a", "seg_b", F.floor((F.col("last") + F.col("first")) / 2).alias("position"), (1 - (F.col("ab") + F.col("ba")) / 2).alias("strength"))


def merge_near(boundaries: DataFrame, group: list[str], near: int = 5) -> DataFrame:
    """group, position, strength, type, n: a boundary joins the group whose first lies at most `near` before it; the largest strength, the types joined by +.

    Chains are cut first at gaps of more than `near`, where a new group always begins, so that only a chain's boundaries meet in an array.
    """
    by_place = Window.partitionBy(*group).orderBy("position", "type", "strength")
    gap = F.col("position") - F.lag("position").over(by_place) > near
    rows = boundaries.withColumn("__new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("__chain", F.sum("__new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(F.col("position").cast("long").alias("p"), "type", "strength")
    rows = rows.groupBy(*group, "__chain").agg(F.array_sort(F.collect_list(item)).alias("bs"))
    one = "struct<p:bigint,strength:double,types:array<string>,n:int>"
    start = F.struct(F.array().cast(f"array<{one}>").alias("out"), F.lit(None).cast(one).alias("cur"))

    def step(a: Column, b: Column) -> Column:
        fresh = F.struct(b["p"].alias("p"), b["strength"].alias("strength"), F.array(b["type"]).alias("types"), F.lit(1).alias("n"))
        cur = a["cur"]
        grown = F.struct(cur["p"].alias("p"), F.greatest(cur["strength"], b["strength"]).alias("strength"), F.concat(cur["types"], F.array(b["type"])).alias("types"), (cur["n"] + 1).alias("n"))
        return (
            F.when(cur.isNull(), F.struct(a["out"].alias("out"), fresh.alias("cur")))
            .when(b["p"] - cur["p"] <= near, F.struct(a["out"].alias("out"), grown.alias("cur")))
            .otherwise(F.struct(F.concat(a["out"], F.array(cur)).alias("out"), fresh.alias("cur")))
        )

    done = F.aggregate("bs", start, step, lambda a: F.when(a["cur"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))
    rows = rows.select(*group, F.explode(done).alias("x"))
    return rows.select(*group, F.col("x.p").alias("position"), F.col("x.strength").alias("strength"), F.array_join(F.array_sort(F.array_distinct("x.types")), "+").alias("type"), F.col("x.n").alias("n"))


def bias(positions: DataFrame, length: int, kind: str = "BOUNDARY", keys: list[str] | None = None) -> DataFrame:
    """keys, i, j, bias: what the positions (keys, pos) add to the attention of a text or window of `length` tokens, summed; cells without any are absent."""
    keys = keys or []
    full = F.explode(F.sequence(F.lit(0), F.lit(length - 1)))
    p = F.col("pos")
    pick = lambda df, c: df.filter(c).select(*keys, "i", "j", F.lit(BIAS.get(kind, 0.1)).alias("b"))
    around = lambda r: F.explode(F.sequence(F.greatest(p - r, F.lit(0)), F.least(p + r, F.lit(length - 1))))
    box = lambda r: positions.select(*keys, "pos", around(r).alias("i")).select(*keys, "pos", "i", around(r).alias("j"))
    if kind in ("BOUNDARY", "SPEAKER_BOUNDARY"):
        near = positions.filter((p > 0) & (p < length)).select(*keys, "pos", F.explode(F.sequence(p - 1, p)).alias("a")).select(*keys, "pos", "a", full.alias("c"))
        near = near.filter(F.col("c") > p)
        cells = pick(near.select(*keys, "pos", F.col("a").alias("i"), F.col("c").alias("j")), F.lit(True)).unionByName(pick(near.select(*keys, "pos", F.col("c").alias("i"), F.col("a").alias("j")), F.lit(True)))
    elif kind == "REFERENCE":
        cells = pick(positions.select(*keys, "pos", p.alias("i"), full.alias("j")), F.col("j") < F.col("i"))
    elif kind == "TOPIC_EVOLUTION":
        cells = pick(box(3), F.lit(True))
    else:
        cells = pick(box(1), (p > 0) & (p < length - 1))
    return cells.groupBy(*keys, "i", "j").agg(F.sum("b").alias("bias"))


def sparse(cells: DataFrame, threshold: float = 0.01) -> DataFrame:
    return cells.filter(F.abs("w") > threshold)


def sparse_softmax(cells: DataFrame, n: int, group: list[str]) -> DataFrame:
    """Row softmax in which absent cells still count as e^0."""
    total = F.sum(F.exp("w")).over(Window.partitionBy(*group, "i")) + (n - F.count("*").over(Window.partitionBy(*group, "i")))
    return cells.withColumn("w", F.exp("w") / total)


def memory_saving(n: int, sparsity: float = 0.9) -> float:
    """Dense bytes over sparse bytes of an n x n matrix: 4 a cell against 12 a kept cell."""
    return 4 * n * n / (12 * n * n * (1 - sparsity))


def use_sparse_path(length: Column, density: Column) -> Column:
    return F.when((length > 1024) | (density > 0.3), "dual").otherwise("standard")


def _svd(ratio: float, most: int, by_mass: bool):
    def run(table: pa.Table) -> pa.Table:
        """One matrix: rank, share of mass kept, and the low-rank cells."""
        i, j, w = (table[c].to_numpy() for c in ("i", "j", "w"))
        n = int(max(i.max(), j.max())) + 1
        m = np.zeros((n, n))
        m[i, j] = w
        u, s, v = np.linalg.svd(m)
        if by_mass:
            r = min(int(np.searchsorted(np.cumsum(s), (1 - ratio) * s.sum()) + 1), int(n * ratio))
        else:
            r = min(max(1, int(n * ratio)), most, n)
        low = (u[:, :r] * s[:r]) @ v[:r]
        a, b = np.indices((n, n)).reshape(2, -1)
        keys = {c: pa.array([table[c][0].as_py()] * (n * n), table.schema.field(c).type) for c in ("window_idx", "layer", "head")}
        return pa.table([*keys.values(), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(low.ravel()), pa.array([r] * (n * n), pa.int32()), pa.array([float(s[:r].sum() / max(s.sum(), 1e-300))] * (n * n))], [*keys, "i", "j", "w", "rank", "kept"])

    return run


def low_rank(attn: DataFrame, ratio: float = 0.3, most: int = 64, by_mass: bool = False) -> DataFrame:
    """attn's cells from a truncated singular value decomposition of each (window, layer, head), with rank and the share of singular mass kept.

    The rank is a share of the size, between 1 and most; by_mass takes the smallest rank that keeps 1 - ratio of the mass, not over that share (0 gives the zero matrix).
    """
    schema = "window_idx long, layer int, head int, i int, j int, w double, rank int, kept double"
    return attn.groupBy("window_idx", "layer", "head").applyInArrow(_svd(ratio, most, by_mass), schema)


def spectra(attn: DataFrame) -> DataFrame:
    """window_idx, layer, head, k (from 1), s: the singular values of each matrix in falling order."""

    def run(table: pa.Table) -> pa.Table:
        i, j, w = (table[c].to_numpy() for c in ("i", "j", "w"))
        m = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
        m[i, j] = w
        s = np.linalg.svd(m, compute_uv=False)
        keys = {c: pa.array([table[c][0].as_py()] * len(s), table.schema.field(c).type) for c in ("window_idx", "layer", "head")}
        return pa.table([*keys.values(), pa.array(np.arange(1, len(s) + 1), pa.int32()), pa.array(s)], [*keys, "k", "s"])

    return attn.groupBy("window_idx", "layer", "head").applyInArrow(run, "window_idx long, layer int, head int, k int, s double")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _truncated(scores: np.ndarray, ratio: float, most: int) -> np.ndarray:
    u, s, v = np.linalg.svd(scores, full_matrices=False)
    r = min(max(1, int(min(scores.shape) * ratio)), most)
    return (u[:, :r] * s[:r]) @ v[:r]


def blockwise_attention(vectors: DataFrame, heads: int, block: int = 64, adaptive: bool = True, most: int = 256) -> DataFrame:
    """window_idx, i, out: low-rank attention of each window's vectors (window_idx, i, vec) to themselves in blocks.

    A pair of blocks keeps .3 of its ranks on the diagonal and .1 off it, or .2 everywhere if not adaptive (at least one, at most `most`); a block's outputs over all
    key blocks are summed. Vectors of a window are of one length, a multiple of heads; null vectors, and those that hold nulls, are left out.
    """

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["i"].to_numpy())
        lists = table["vec"].combine_chunks()
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), heads, -1)[order].transpose(1, 0, 2)
        out = np.zeros_like(x)
        n, d = x.shape[1:]
        for a in range(0, n, block):
            for b in range(0, n, block):
                ratio = (0.3 if a == b else 0.1) if adaptive else 0.2
                for h in range(heads):
                    q, k = x[h, a : a + block], x[h, b : b + block]
                    out[h, a : a + block] += _softmax(_truncated(q @ k.T / np.sqrt(d), ratio, most)) @ k
        flat = out.transpose(1, 0, 2).reshape(n, -1)
        at = pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32())
        return pa.table([pa.array([table["window_idx"][0].as_py()] * n, pa.int64()), pa.array(table["i"].to_numpy()[order], pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat.ravel()))], ["window_idx", "i", "out"])

    whole = F.col("window_idx").isNotNull() & F.col("i").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull())
    rows = vectors.filter(whole).select(F.col("window_idx").cast("long").alias("window_idx"), F.col("i").cast("long").alias("i"), F.transform("vec", lambda v: v.cast("double")).alias("vec"))
    return rows.groupBy("window_idx").applyInArrow(run, "window_idx long, i long, out array<double>")


def constrained_low_rank(scores: DataFrame, ratio: float = 0.1, most: int = 256) -> DataFrame:
    """window_idx, i, j, w: the mean over heads of the row softmax of each head's scores (window_idx, head, i, j, s; with their bias and mask), cut to the share
    `ratio` of their ranks. Cells that are absent score 0."""

    def run(table: pa.Table) -> pa.Table:
        heads, i, j, s = (table[c].to_numpy() for c in ("head", "i", "j", "s"))
        n = int(max(i.max(), j.max())) + 1
        total = np.zeros((n, n))
        for h in np.unique(heads):
            m = np.zeros((n, n))
            own = heads == h
            m[i[own], j[own]] = s[own]
            total += _softmax(_truncated(m, ratio, most))
        a, b = np.indices((n, n)).reshape(2, -1)
        return pa.table([pa.array([table["window_idx"][0].as_py()] * (n * n), pa.int64()), pa.array(a), pa.array(b), pa.array((total / len(np.unique(heads))).ravel())], ["window_idx", "i", "j", "w"])

    rows = scores.select(*[F.col(c).cast("long").alias(c) for c in ("window_idx", "head", "i", "j")], "s")
    return rows.groupBy("window_idx").applyInArrow(run, "window_idx long, i long, j long, w double")


def adaptive_rank(spectra: DataFrame, target: float, least: int, most: int) -> DataFrame:
    """id, rank: the smallest k whose singular values (id, k from 1, s in falling order) sum to 1 - target of all, within bounds."""
    order = Window.partitionBy("id").orderBy("k")
    rows = spectra.withColumn("c", F.sum("s").over(order)).withColumn("t", F.sum("s").over(Window.partitionBy("id")))
    return rows.filter(F.col("c") >= F.col("t") * (1 - target)).groupBy("id").agg(F.greatest(F.lit(least), F.least(F.lit(most), F.min("k"))).alias("rank"))


def layer_stats(attn: DataFrame, n: int, threshold: float = 0.1) -> DataFrame:
    """layer, edges (cells over threshold), density (share of all n * n cells of all windows and heads)."""
    blocks = attn.select("window_idx", "layer", "head").distinct().groupBy("layer").agg(F.count("*").alias("blocks"))
    hits = attn.filter(F.col("w") > threshold).groupBy("layer").agg(F.count("*").alias("edges"))
    return blocks.join(hits, "layer", "left").na.fill(0, ["edges"]).select("layer", "edges", (F.col("edges") / (F.col("blocks") * n * n)).alias("density"))


def top_edges(attn: DataFrame, k: int = 5) -> DataFrame:
    """window_idx, layer, rank, i, j, w: the strongest cells of each layer's head mean, off the diagonal."""
    mean = attn.filter("i <> j").groupBy("window_idx", "layer", "i", "j").agg(F.round(F.avg("w"), 9).alias("w"))
    rank = F.row_number().over(Window.partitionBy("window_idx", "layer").orderBy(F.desc("w"), "i", "j"))
    return mean.withColumn("rank", rank).filter(F.col("rank") <= k)


def constrained_scores(scores: DataFrame, types: DataFrame, biases: DataFrame, adjacency: DataFrame, keys: list[str]) -> DataFrame:
    """scores (keys, i, j, s) plus their edge type's bias, cells without an edge pushed down by 1e4."""
    rows = scores.join(types, [*keys, "i", "j"], "left").withColumn("edge_type", F.coalesce("edge_type", F.lit(0))).join(F.broadcast(biases.select("edge_type", "default_bias")), "edge_type", "left")
    rows = rows.join(adjacency.select(*keys, "i", "j", F.lit(1).alias("a")), [*keys, "i", "j"], "left")
    return rows.select(*keys, "i", "j", (F.col("s") + F.coalesce("default_bias", F.lit(0.0)) - F.when(F.col("a").isNull(), 1e4).otherwise(0.0)).alias("s"))


def constrained(scores: DataFrame, types: DataFrame, biases: DataFrame, adjacency: DataFrame) -> DataFrame:
    """window_idx, i, j, w: row softmax of the constrained scores (window_idx, i, j, s)."""
    rows = constrained_scores(scores, types, biases, adjacency, ["window_idx"])
    row = Window.partitionBy("window_idx", "i")
    rows = rows.withColumn("x", F.exp(F.col("s") - F.max("s").over(row)))
    return rows.select("window_idx", "i", "j", (F.col("x") / F.sum("x").over(row)).alias("w"))


def window_segments(windows: DataFrame, segments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, win_idx, pos (in the window), seg_idx: windows (keys, win_idx, begin, end) meet segments (keys, seg_idx, begin, end) where they overlap; the last segment wins, 0 where none is."""
    keys = keys or []
    pos = windows.select(*keys, "win_idx", "begin", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("p"))
    segs = segments.select(*keys, "seg_idx", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("p")).groupBy(*keys, "p").agg(F.max("seg_idx").alias("seg_idx"))
    return pos.join(segs, [*keys, "p"], "left").select(*keys, "win_idx", (F.col("p") - F.col("begin")).alias("pos"), F.coalesce("seg_idx", F.lit(0)).alias("seg_idx"))


def _round9(x: float | None) -> float | None:
    """As Spark's round to 9 decimals: halves of the shortest decimal go up."""
    if x is None or not math.isfinite(x):
        return x
    return float(_DECIMALS.quantize(Decimal(repr(x)), Decimal("1e-9")))


def _followed_ranks(least: int, most: int, first: float, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of head and win. All that is kept from one to the next is the head, the sum of its complexities and their number."""
        head, total, count = None, 0.0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                heads, made = batch["head"].to_pylist(), []
                for h, n, c in zip(heads, batch["n"].to_pylist(), batch["c"]):
                    if h != head:
                        head, total, count = h, 0.0, 0
                    target = first if not count else None if total is None else _round9(total / count)
                    rank = most
                    if c.is_valid:
                        c = c.values.to_numpy(zero_copy_only=False)
                        bound = None if target is None or not len(c) or np.isnan(c[-1]) else _round9(float(c[-1]) * (1 - target))
                        rank = min(most, (0 if bound is None else int(np.count_nonzero(c < bound))) + 1)
                    rank = max(least, rank)
                    total, count = None if total is None or n is None else total + rank / n, count + 1
                    made.append((rank, target, None if total is None else _round9(total / count)))
                cols = [pa.array(x, t) for x, t in zip(zip(*made), (pa.int64(), pa.float64(), pa.float64()))]
                yield pa.record_batch([batch["head"], batch["win"], *cols], ["head", "win", "rank", "target", "mean"])

    return run


def adaptive_rank_history(spectra: DataFrame, least: int, most: int, first: float = 0.5, chunk: int = 512) -> DataFrame:
    """head, win, rank, target, mean: ranks that follow those of the head's earlier windows.

    spectra: head, win (from 0, without gaps), n (size of the matrix), s (array of its singular values in falling order). A window's target is the mean complexity, rank over n, of all
    windows before it (`first` for the first); its rank is the smallest k whose values sum to 1 - target of all, within bounds; mean is the mean complexity up to it.
    A head's windows depend on each other in order, so they are folded: heads side by side, and a head's windows sorted and streamed through one task, which holds a batch and
    works on chunk rows at a time. The driver has one job, however many windows there are. Windows without values have rank `least`.
    """
    cum = F.aggregate("s", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.round(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x, 9))))
    rows = spectra.filter("head IS NOT NULL AND win IS NOT NULL").select("head", F.col("win").cast("long").alias("win"), F.col("n").cast("double").alias("n"), cum.alias("c"))
    out = StructType([rows.schema["head"], *(StructField(c, t) for c, t in (("win", LongType()), ("rank", LongType()), ("target", DoubleType()), ("mean", DoubleType())))])
    return rows.repartition("head").sortWithinPartitions("head", "win", "n", "c").mapInArrow(_followed_ranks(least, most, first, chunk), out)

"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Each document's word shingles are hashed once; its set's hash groups equal sets into classes, one node each.
2. A node keeps its k smallest hashes. Two sets alike enough share at least t retained values, so it is enough to list the rarest
   |sketch| - t + 1 values of each node (values that only one node has come first and cost nothing). What these inverted lists connect is
   a family, and families are gathered into cells of bounded rows and bytes.
3. In a cell the members' inverted lists of retained values generate the overlap of each pair. Pairs that overlap enough, strongest first, are
   filtered by the estimate from their union sketch, and verified by the exact Jaccard coefficient of the full sets. Pairs that
   links join already are skipped, and a cell gives only a spanning forest of its links.
4. A family that doesn't fit a cell first meets its lists' most central nodes alone, by the same estimate and exact check. Of what stays
   apart the exact prefix rule over full sets leaves only nodes that share one of their rarest quarter of shingles with a node of another
   component; these families, if they don't fit a cell either, are cut into blocks: those outside the main component meet all others.

Nothing is emitted for pairs, so large groups of copies cost their size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType

from loomspark.llm.common import NULL_ID, Scratch, give_back_memory, hot_split_join, keyed, text_bytes, trim
from loomspark.operators.graph import component_labels

MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's word shingles; with fewer words one for the whole sequence."""
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    size = min(words, n)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h += own[j : n - size + 1 + j] * np.uint64(MIX[j % 8] + 2 * (j // 8))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def _facts_udf(words: int, k: int):
    kind = pa.struct([("n", pa.int64()), ("set_hash", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n:long,set_hash:binary,sketch:array<long>>")
    def facts(texts: pa.Array) -> pa.Array:
        sizes, hashes, sketches, at = [], [], [], [0]
        for t in texts:
            s = shingle_set(t.as_py(), words)
            sizes.append(len(s))
            hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
            sketches.append(s[:k].copy())  # a slice would keep the whole set
            at.append(at[-1] + min(len(s), k))
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sketches) if sketches else [], pa.int64()))
        trim()
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), lists], fields=list(kind))

    return facts


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) pairs to (node, comp): the smallest node of each connected component."""
    labels = component_labels(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), lambda df, step: scratch.write(df, f"{name}-{step}"))
    return labels.withColumnRenamed("id", "node")


def _overlaps(sketches: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """(rows x cols) numbers of values that two sketches share, from the inverted list of each value."""
    owner = np.repeat(np.arange(len(sketches)), [len(x) for x in sketches])
    values = np.concatenate(sketches)
    order = np.argsort(values, kind="stable")
    owner, lists = owner[order], np.cumsum(np.append(False, np.diff(values[order]) != 0))
    place = np.full((2, len(sketches)), -1)
    place[0, rows], place[1, cols] = np.arange(len(rows)), np.arange(len(cols))
    r, c = np.flatnonzero(place[0, owner] >= 0), np.flatnonzero(place[1, owner] >= 0)
    held = np.bincount(lists[c], minlength=lists[-1] + 1)
    begin, times = np.cumsum(held) - held, held[lists[r]]
    out = np.zeros(len(rows) * len(cols), np.int32)
    cuts = np.flatnonzero(np.diff(np.cumsum(times) // most)) + 1
    for part in np.split(np.arange(len(r)), cuts):
        n = times[part]
        at = np.repeat(begin[lists[r[part]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out += np.bincount(np.repeat(place[0, owner[r[part]]], n) * len(cols) + place[1, owner[c[at]]], minlength=len(out)).astype(np.int32)
    return out.reshape(len(rows), len(cols))


def _estimates(padded: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Jaccard estimate of each pair: how much of the union's k smallest values both hold."""
    out = np.empty(len(a))
    for i in range(0, len(a), 4096):
        both = np.sort(np.concatenate([padded[a[i : i + 4096]], padded[b[i : i + 4096]]], axis=1), axis=1)
        real = both < np.iinfo(np.int64).max
        again = np.zeros(both.shape, bool)
        again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
        distinct = np.cumsum(real & ~again, axis=1)
        out[i : i + 4096] = (again & (distinct <= k)).sum(axis=1) / np.maximum(np.minimum(distinct[:, -1], k), 1)
    return out


def _products(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, wide: int = 4096) -> np.ndarray:
    """Intersection sizes of rows' sets with cols' sets, by slices of the values that two sets at least hold."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    keep = counts[code] > 1
    code, owner = place[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    total = int(code[-1]) + 1 if len(code) else 0
    for base in range(0, total, wide):
        a, b = np.searchsorted(code, (base, base + wide))
        part = np.zeros((len(sets), min(wide, total - base)), np.float32)
        part[owner[a:b], code[a:b] - base] = 1
        out += part[rows] @ part[cols].T
    return out


def spanning_links(sets: list[np.ndarray], label: np.ndarray, rows: np.ndarray, cols: np.ndarray, percent: int, k: int) -> list[tuple[int, int]]:
    """Links between rows and cols (places in sets) that join what label sets apart: enough of them to join all that links join."""
    share, few, slack = percent / 100, *sketch_bounds(percent, k)
    size = np.array([len(x) for x in sets])
    sketches = [x[:k] for x in sets]
    shared = _overlaps(sketches, rows, cols)
    larger = np.maximum(size[rows][:, None], size[cols][None, :])
    may = (shared >= np.where(larger <= k, np.ceil(larger * share), few)) & (100 * np.minimum(size[rows][:, None], size[cols][None, :]) >= percent * larger)
    a, b = np.nonzero(may & (label[rows][:, None] != label[cols][None, :]))
    if not len(a):
        return []
    order = np.argsort(-shared[a, b] / larger[a, b].clip(max=k), kind="stable")
    a, b = a[order], b[order]
    padded = np.full((len(sets), k), np.iinfo(np.int64).max)
    for i, x in enumerate(sketches):
        padded[i, : len(x)] = x
    label = np.unique(label, return_inverse=True)[1]
    parent = list(range(label.max() + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found, exact, step = [], None, len(sets)
    while len(a):
        now = np.fromiter(map(root, range(len(parent))), np.int64, len(parent))[label]
        apart = now[rows[a]] != now[cols[b]]
        a, b = a[apart], b[apart]
        x, y, i, j = rows[a[:step]], cols[b[:step]], a[:step], b[:step]
        whole = np.maximum(size[x], size[y]) <= k
        likely = _estimates(padded, x, y, k) >= share - np.where(whole, 1e-9, slack)
        if exact is None and likely.sum() > 16 * len(sets):
            exact = _products(sets, rows, cols)
        for p, q, v, w in zip(x[likely].tolist(), y[likely].tolist(), i[likely].tolist(), j[likely].tolist()):
            if root(label[p]) != root(label[q]):
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True)) if exact is None else int(exact[v, w])
                if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                    found.append((p, q))
                    parent[root(label[p])] = root(label[q])
        a, b, step = a[step:], b[step:], 2 * step
    return found


def sketch_bounds(percent: int, k: int) -> tuple[int, float]:
    """What two sets at the threshold share of k retained values at least, and how far an estimate lies below it at most: six and five
    standard deviations."""
    share = percent / 100
    spread = (share * (1 - share) / k) ** 0.5
    return int(k * (share - 6 * spread)), 5 * spread


def _family_udf(percent: int, k: int):
    def compare(table: pa.Table) -> pa.Table:
        """Families of a cell, each by itself: spanning links between members."""
        fam, node, comp, row, col = (table.column(c).to_numpy(zero_copy_only=False) for c in ("fam", "node", "comp", "is_row", "is_col"))
        raw = table.column("full").combine_chunks()
        out_a, out_b = [], []
        order = np.argsort(fam, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(fam[order])) + 1):
            rows, cols = np.flatnonzero(row[own]), np.flatnonzero(col[own])
            if len(rows) and len(cols):
                sets = [np.frombuffer(raw[int(i)].as_buffer(), np.int64) for i in own]
                # a node may stand both as a row and as a column; it has one label
                for i, j in spanning_links(sets, comp[own], rows, cols, percent, k):
                    out_a.append(int(node[own[i]]))
                    out_b.append(int(node[own[j]]))
        done, large = pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"]), table.nbytes > 1 << 20
        del table, raw
        if large:
            give_back_memory()
        return done

    return compare


def _full_udf(words: int):
    @F.arrow_udf(BinaryType())
    def full(texts: pa.Array) -> pa.Array:
        sets = pa.array([shingle_set(t.as_py(), words).tobytes() for t in texts], pa.binary())
        trim()
        return sets

    return full


@F.arrow_udf(ArrayType(LongType()))
def _values_of(full: pa.Array) -> pa.Array:
    """The hashes of sets stored as bytes."""
    sets = [np.frombuffer(x.as_buffer(), np.int64) for x in full]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets) if sets else [], pa.int64()))


def _may_be_in(nodes: DataFrame, id_col: str, most_bits: int):
    """A filter by id: a bitmap of the nodes' id hashes, 16 bits a node. Lets rows through by chance, never keeps one out. Beyond most_bits
    (a bound on what each task is sent) it grows denser, and at last lets all rows through, which then only cost the shuffle."""
    bits = min(most_bits, 1 << max(20, (16 * nodes.count()).bit_length()))
    h = F.pmod(F.xxhash64(id_col), F.lit(bits)) + 1
    found = nodes.select(h.alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m")).collect()
    maps = np.zeros(bits // 8, np.uint8)
    for r in found:
        part = np.frombuffer(r.m, np.uint8)
        at = (r.k - 1) * 4096
        maps[at : at + len(part)] = part[: len(maps) - at]
    packed = maps.tobytes()

    @F.arrow_udf(BooleanType())
    def held(hashes: pa.Array) -> pa.Array:
        at = hashes.to_numpy() - 1
        return pa.array((np.frombuffer(packed, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1, pa.bool_())

    return held(h)


def _assigned(docs: DataFrame, words: int, percent: int, k: int, id_col: str, text_col: str, filter_bits: int, cell_rows: int = 512, cell_bytes: int = 16 << 20) -> DataFrame:
    """Per row of docs: __id, __null, th (hash of the text), n, component; a written table."""

    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    share = percent / 100
    few, _ = sketch_bounds(percent, k)
    rows = keyed(docs.select(id_col, text_col), id_col).select("__id", F.col(id_col).isNull().alias("__null"), text_bytes(text_col).alias("__t"))
    facts = rows.select("__id", "__null", F.xxhash64("__t").alias("th"), _facts_udf(words, k)(F.col("__t")).alias("f"))
    facts = scratch.write(facts.select(F.monotonically_increasing_id().alias("node"), "__id", "__null", "th", "f.*"), "facts")

    classes = facts.filter("n > 0").groupBy("set_hash").agg(F.min("node").alias("node"), F.min("__id").alias("min_id"), F.count("*").alias("rows"))
    classes = scratch.write(classes, "classes")
    nodes = facts.select("node", "__id", "th", "n", "sketch").join(classes.select("node").hint("merge"), "node")
    nodes = scratch.write(nodes, "nodes")
    weight = F.lit(1 / cell_rows) + F.col("n") * F.lit(8 / cell_bytes)  # of a cell

    values = nodes.select("node", F.explode("sketch").alias("v"))
    shared = scratch.write(values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    common = hot_split_join(values, shared, "v", "df")
    per_node = common.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    per_node = per_node.join(nodes.select("node", "n", F.size("sketch").alias("held")).hint("merge"), "node")
    need = F.when(F.col("n") <= F.lit(share * k), F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(few))
    look = F.col("held") - need + 1 - (F.col("held") - F.size("vs"))
    lists = per_node.withColumn("look", look).filter("look > 0").select("node", "n", (F.col("held") - F.size("vs")).alias("alone"), F.explode(F.slice("vs", F.lit(1), F.col("look").cast("int"))).alias("e"))
    lists = scratch.write(lists.select(F.col("e.v").alias("v"), "node", "n", "alone"), "lists")

    heads = lists.groupBy("v").agg(F.count("*").alias("m"), F.min(F.struct("alone", "node")).alias("head")).filter("m > 1")
    heads = scratch.write(heads.select("v", "m", F.col("head.node").alias("b")), "heads")
    star = hot_split_join(lists, heads, "v", "m").filter(F.col("node") != F.col("b"))
    star = scratch.write(star.select(F.col("node").alias("a"), "b").distinct(), "star")

    families = components(star, scratch, "families").withColumnRenamed("comp", "fam").join(nodes.select("node", "n", "__id", "th").hint("merge"), "node")
    families = scratch.write(families.select("fam", "node", weight.alias("w"), "__id", "th"), "families-weighed")
    sizes = scratch.write(families.groupBy("fam").agg(F.count("*").alias("m"), F.sum("w").alias("held")), "family-sizes")
    texts = rows.filter(_may_be_in(families, "__id", filter_bits)).withColumn("th", F.xxhash64("__t"))
    full = texts.join(families.select("node", "__id", "th").hint("merge"), ["__id", "th"]).select("node", _full_udf(words)(F.col("__t")).alias("full")).dropDuplicates(["node"])
    whole = hot_split_join(families.select("fam", "node", "w"), sizes, "fam", "m").drop("m").join(full.hint("merge"), "node")
    whole = scratch.write(whole, "whole")

    cols = ["fam", "i", "j", "node", "comp", "full", "is_row", "is_col"]
    compare = _family_udf(percent, k)

    def in_cells(members: DataFrame, total: float) -> DataFrame:
        """Links within families that fit a cell; members: fam, node, comp, full."""
        cells = max(1, math.ceil((total or 0) / 2))
        both = {"i": F.pmod(F.xxhash64("fam"), F.lit(cells)).cast("int"), "j": F.lit(-1), "is_row": F.lit(True), "is_col": F.lit(True)}
        return members.withColumns(both).select(*cols).groupBy("i", "j").applyInArrow(compare, "a long, b long")

    fits = sizes.agg(F.sum(F.when(F.col("held") <= 1, F.col("held")))).first()[0]
    edges = in_cells(whole.filter("held <= 1").withColumn("comp", F.col("node")), fits)
    first = None
    if sizes.filter("held > 1").limit(1).count():
        big = whole.filter("held > 1").select("fam", "node", "w", "full")
        # each member against its lists' heads; a head stands in as many cells as its members fill
        pairs = scratch.write(star.join(big.select(F.col("node").alias("a"), "w").hint("merge"), "a"), "inside")
        heads = scratch.write(pairs.groupBy("b").agg(F.count("*").alias("rows"), F.ceil(F.sum("w")).cast("int").alias("parts")), "inside-heads")
        part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")
        spokes = hot_split_join(pairs.select("a", "b"), heads, "b", "rows").select("b", part, F.col("a").alias("node"), F.lit(True).alias("is_row"))
        hubs = heads.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("node"), F.lit(False).alias("is_row"))
        met = spokes.unionByName(hubs).join(big.select("node", "full").hint("merge"), "node")
        cells = max(1, math.ceil((pairs.agg(F.sum("w")).first()[0] or 0) / 2))
        met = met.withColumns({"fam": F.xxhash64("b", "part"), "comp": F.col("node"), "j": F.lit(-1), "is_col": ~F.col("is_row")})
        met = met.withColumn("i", F.pmod(F.xxhash64("fam"), F.lit(cells)).cast("int"))
        first = scratch.write(met.select(*cols).groupBy("i").applyInArrow(compare, "a long, b long"), "first")
        labels = components(first, scratch, "first-labels")
        large = scratch.write(big.drop("full").join(labels.hint("merge"), "node", "left").select("fam", "node", "w", F.coalesce("comp", "node").alias("comp")), "labelled")
        open_ = large.groupBy("fam").agg(F.count("*").alias("m"), (F.min("comp") != F.max("comp")).alias("open")).filter("open")
        apart = hot_split_join(large, scratch.write(open_.select("fam", "m"), "open"), "fam", "m").select("node", "w", "comp")
        apart = scratch.write(apart.join(big.select("node", "full").hint("merge"), "node"), "apart")
        # the exact prefix rule: two sets alike enough share one of the n - need + 1 rarest shingles of each
        each = scratch.write(apart.select("node", F.explode(_values_of(F.col("full"))).alias("v")), "apart-values")
        often = scratch.write(each.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "apart-shared")
        vs = hot_split_join(each, often, "v", "df").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
        vs = vs.join(apart.select("node", "comp", (F.octet_length("full") / 8).cast("long").alias("n")).hint("merge"), "node")
        vs = vs.withColumn("look", F.size("vs") - F.ceil(F.col("n") * percent / 100) + 1).filter("look > 0")
        near = scratch.write(vs.select("node", "comp", F.explode(F.slice("vs", F.lit(1), F.col("look").cast("int"))).alias("e")).select("node", "comp", F.col("e.v").alias("v")), "apart-lists")
        scratch.drop("apart-values", "apart-shared")
        heads = near.groupBy("v").agg(F.count("*").alias("m"), F.min("node").alias("b"), (F.min("comp") != F.max("comp")).alias("open")).filter("open")
        again = hot_split_join(near, scratch.write(heads.select("v", "m", "b"), "apart-heads"), "v", "m").filter(F.col("node") != F.col("b"))
        again = components(again.select(F.col("node").alias("a"), "b").distinct(), scratch, "apart-families").withColumnRenamed("comp", "fam")
        members = scratch.write(again.join(apart.hint("merge"), "node").select("fam", "node", "w", "comp", "full"), "members")
        main = members.groupBy("fam", "comp").agg(F.count("*").alias("c"), F.sum("w").alias("cw")).groupBy("fam").agg(F.sum("c").alias("m"), F.sum("cw").alias("held"), F.max_by(F.struct("comp", "c", "cw"), F.struct("c", "comp")).alias("main"))
        main = scratch.write(main, "main")
        placed = scratch.write(hot_split_join(members, main, "fam", "m"), "placed")
        edges = edges.unionByName(in_cells(placed.filter("held <= 1"), main.agg(F.sum(F.when(F.col("held") <= 1, F.col("held")))).first()[0]))
        large = placed.filter("held > 1")
        several = F.col("main.c") > 1
        n_i, n_j = F.ceil(F.col("held") - F.when(several, F.col("main.cw")).otherwise(0.0) + 1e-6).cast("int"), F.ceil(F.col("held") / 2).cast("int")
        spot = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
        as_rows = large.filter((F.col("comp") != F.col("main.comp")) | ~several).withColumns({"i": spot(n_i, 1), "j": F.explode(F.sequence(F.lit(0), n_j - 1)), "is_row": F.lit(True), "is_col": F.lit(False)})
        as_cols = large.withColumns({"j": spot(n_j, 2), "i": F.explode(F.sequence(F.lit(0), n_i - 1)), "is_row": F.lit(False), "is_col": F.lit(True)})
        grid = as_rows.select(*cols).unionByName(as_cols.select(*cols))
        edges = edges.unionByName(grid.groupBy("fam", "i", "j").applyInArrow(compare, "a long, b long"))
    if first is not None:
        edges = edges.unionByName(first)
    edges = scratch.write(edges.filter("a <> b"), "edges")
    scratch.drop("whole", "placed", "members", "apart")
    labels = components(edges, scratch, "labels")

    reach = classes.join(labels.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = reach.groupBy("comp").agg(F.min("min_id").alias("component"), F.count("*").alias("n_classes"))
    reach = scratch.write(hot_split_join(scratch.write(reach, "reach"), scratch.write(smallest, "smallest"), "comp", "n_classes").select("set_hash", "component", "rows"), "components")
    full = facts.filter("n > 0").select("__id", "__null", "th", "n", "set_hash")
    out = hot_split_join(full, reach, "set_hash", "rows").select("__id", "__null", "th", "n", "component")
    none = facts.filter("n = 0").select("__id", "__null", "th", "n", F.col("__id").alias("component"))
    out = scratch.write(out.unionByName(none), "result")
    scratch.drop(*[n for n in scratch.paths if n != "result"])
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, k: int = 64, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 27, cell_rows: int = 512, cell_bytes: int = 16 << 20) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id, kept.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set has its distinct shingles of `words` words (with fewer
    words, the whole sequence). Documents whose sets have 100 * intersection >= percent * union are linked; component_id is the smallest
    id that links reach, and kept marks the rows with that id.

    Null or empty text: an empty set, linked with nothing. A null id counts as smaller than all others and comes back null. Rows that repeat an id
    are compared each by their own text. Other columns stay out. An empty table gives an empty table.

    cell_rows and cell_bytes (of hashes) bound what meets in a task; they change no result. A link between different sets is found if both sketches share at least t values. Up to 0.75 k shingles that is certain; beyond, t lies six
    standard deviations below what a pair at the threshold shares.
    """
    out = _assigned(docs, words, percent, k, id_col, text_col, filter_bits, cell_rows, cell_bytes)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(F.when(~F.col("__null"), F.col("__id")).alias(id_col), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("__id") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, k: int = 64, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 27, cell_rows: int = 512, cell_bytes: int = 16 << 20) -> DataFrame:
    """docs with one row of each component: that of the smallest id, of rows that repeat it the one with the smallest text hash. All
    documents without words stay, once for each id. The cases are those of near_duplicates; all columns are kept.
    """
    rows = _assigned(docs, words, percent, k, id_col, text_col, filter_bits, cell_rows, cell_bytes)
    stay = rows.filter("__id = component").groupBy("component", (F.col("n") == 0).alias("empty")).agg(F.min("th").alias("__th")).select(F.col("component").alias("__id"), "__th").distinct()
    named = keyed(docs, id_col).withColumn("__th", F.xxhash64(text_bytes(text_col)))
    first = F.row_number().over(Window.partitionBy("__id", "__th").orderBy("__th"))
    out = named.join(stay.hint("merge"), ["__id", "__th"]).withColumn("__k", first).filter("__k = 1")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws] ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i : i + 4]) END) AS sh FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a AS src, b AS dst FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT b.src, reach.r FROM reach JOIN both_ways b ON b.dst = reach.id WHERE reach.r < b.src)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(reach.r) AS component_id, d.doc_id = min(reach.r) AS kept
FROM documents d JOIN reach ON reach.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

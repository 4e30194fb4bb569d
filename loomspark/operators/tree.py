"""Segment trees: repeated splitting with offsets, flags and levels, and statistics over the tree.

segments: doc_id, seg_id, parent_id, level, ord, rule_idx, content, start_pos, end_pos, has_code, has_math, atomic, tag.
Ids are paths of zero-padded ordinals, so their order is pre-order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import has_code, has_math, is_blank

COLUMNS = ["doc_id", "seg_id", "parent_id", "level", "ord", "rule_idx", "content", "start_pos", "end_pos", "has_code", "has_math", "atomic", "tag"]


def roots(docs: DataFrame) -> DataFrame:
    """Each whole text as the root of its tree."""
    rows = docs.select("doc_id", F.lit("0").alias("seg_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), F.lit(0).alias("ord"), F.lit(-1).alias("rule_idx"), F.col("text").alias("content"), F.lit(0).alias("start_pos"), F.length("text").alias("end_pos"))
    return rows.withColumns({"has_code": has_code(F.col("content")), "has_math": has_math(F.col("content")), "atomic": F.lit(False), "tag": F.lit("track")}).select(*COLUMNS)


def located(content: Column, pieces: Column) -> Column:
    """Array of (piece, at): each non-blank piece at its first place from the end of the one before it; pieces that aren't found go."""
    kept = F.filter(pieces, lambda p: ~is_blank(p))
    start = F.struct(F.array().cast("array<struct<piece:string,at:int>>").alias("out"), F.lit(0).alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        at = F.call_function("locate", p, content, acc["cur"] + 1) - 1
        found = F.struct(F.concat(acc["out"], F.array(F.struct(p.alias("piece"), at.alias("at")))).alias("out"), (at + F.length(p)).alias("cur"))
        return F.when(at >= 0, found).otherwise(acc)

    return F.aggregate(kept, start, step, lambda a: a["out"])


def children(parents: DataFrame, segment: Callable[[Column], Column], rule_idx: int) -> DataFrame:
    """The children that a rule gives each parent that it splits in more than one piece. Code is kept whole from then on."""
    split = parents.withColumn("__p", segment(F.col("content"))).filter(F.size("__p") > 1)
    placed = split.select("doc_id", F.col("seg_id").alias("parent_id"), (F.col("level") + 1).alias("level"), F.col("start_pos").alias("__s"), F.posexplode(located(F.col("content"), F.col("__p"))).alias("ord", "c"))
    rows = placed.select(
        "doc_id",
        F.concat_ws(".", "parent_id", F.concat(F.lit(f"{rule_idx}-"), F.lpad(F.col("ord").cast("string"), 6, "0"))).alias("seg_id"),
        "parent_id", "level", "ord", F.lit(rule_idx).alias("rule_idx"), F.col("c.piece").alias("content"),
        (F.col("__s") + F.col("c.at")).alias("start_pos"), (F.col("__s") + F.col("c.at") + F.length("c.piece")).alias("end_pos"),
    )
    rows = rows.withColumns({"has_code": has_code(F.col("content")), "has_math": has_math(F.col("content"))})
    return rows.withColumns({"atomic": F.col("has_code"), "tag": F.when(F.col("has_code") | F.col("has_math"), "KEEP").otherwise("track")}).select(*COLUMNS)


def build_tree(docs: DataFrame, rules: list[Callable[[Column], Column]], levels: int = 5, one_rule_a_level: bool = False, first_rule_wins: bool = False, cut: Callable[[DataFrame, int], DataFrame] | None = None, least_split: float = 0.1) -> DataFrame:
    """All segments of every document's tree.

    At each level every rule is tried on every segment of the level before that isn't atomic; one_rule_a_level uses rule k at level k.
    A segment that two rules split has the children of both, unless first_rule_wins. cut may write a level and give it back
    read, which shortens lineage for deep trees; then the loop ends at a level without open segments, and beyond the third one when less than least_split of
    a level's open segments were split. A null text is a root without children.
    """
    level = roots(docs)
    every = level
    for k in range(min(levels, len(rules)) if one_rule_a_level else levels):
        open_ = level.filter("not atomic")
        if cut and not has_pending(open_):
            break
        tried = [(k, rules[k])] if one_rule_a_level else list(enumerate(rules))
        found = None
        for i, rule in tried:
            kids = children(open_, rule, i)
            if found is not None and first_rule_wins:
                kids = kids.join(found.select("doc_id", "parent_id").distinct(), ["doc_id", "parent_id"], "left_anti")
            found = kids if found is None else found.unionByName(kids)
        level = cut(found, k) if cut else found
        every = every.unionByName(level)
        if cut and k >= 2 and level.select("doc_id", "parent_id").distinct().count() < least_split * open_.count():
            break
    return every


def grow(segments: DataFrame, rules: list[Callable[[Column], Column]], cut: Callable[[DataFrame, int | str], DataFrame], done: DataFrame | None = None, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(segments, done): a tree grown on by a frontier of work rows, each a segment and a rule that hasn't seen it.

    A round's frontier is every open segment of any level with every rule, less what `done` (doc_id, seg_id, rule_idx) holds; so a rule added later is tried on all old
    segments, a new document's root on all rules, and nothing twice, which leaves no duplicates. The rounds end when no segment was added. cut writes a round and gives it
    back read. To go on later keep both results.
    """
    tried = [] if done is None else [done]
    every, frontier, known = segments, segments.filter("not atomic"), done
    numbers = F.array(*[F.lit(k) for k in range(len(rules))])
    for k in range(rounds):
        work = frontier.withColumn("__rule", F.explode(numbers))
        if known is not None:
            work = work.join(known.select("doc_id", "seg_id", F.col("rule_idx").alias("__rule")), ["doc_id", "seg_id", "__rule"], "left_anti")
        work = cut(work.select(*COLUMNS, "__rule"), f"work-{k}")
        kids = None
        for i, rule in enumerate(rules):
            found = children(work.filter(F.col("__rule") == i).drop("__rule"), rule, i)
            kids = found if kids is None else kids.unionByName(found)
        kids = cut(kids, f"kids-{k}")
        tried.append(work.select("doc_id", "seg_id", F.col("__rule").alias("rule_idx")))
        if not has_pending(kids):
            break
        every, frontier, known = every.unionByName(kids), kids.filter("not atomic"), None  # what is new no rule has seen
    pairs = tried[0]
    for t in tried[1:]:
        pairs = pairs.unionByName(t)
    return every, pairs


def has_pending(segments: DataFrame) -> bool:
    """Some segment is left to work on."""
    return segments.limit(1).count() > 0


class OpenTree:
    """A tree under construction: levels can be added and edges can't. complete() gives the one with edges."""

    def __init__(self, segments: DataFrame):
        self.segments = segments

    def add(self, kids: DataFrame) -> OpenTree:
        return OpenTree(self.segments.unionByName(kids))

    def pending(self, processed: DataFrame, rules: int) -> DataFrame:
        """Segments that aren't atomic and that some rule hasn't processed (processed: doc_id, seg_id, rule_idx)."""
        open_ = self.segments.filter("not atomic")
        return open_.join(fully_processed(open_, processed, rules).select("doc_id", "seg_id"), ["doc_id", "seg_id"], "left_anti")

    def semantic_edges(self, *_: object) -> DataFrame:
        raise RuntimeError("the tree isn't complete: call complete() before adding semantic edges")

    def complete(self) -> CompleteTree:
        return CompleteTree(self.segments)


class CompleteTree:
    """A finished tree; semantic edges may be added to its hierarchical ones."""

    def __init__(self, segments: DataFrame):
        self.segments = segments

    def semantic_edges(self, pairs: DataFrame) -> DataFrame:
        """doc_id, src, dst, weight, type of the pairs (doc_id, src, dst, weight) within the tree that no hierarchical edge joins, either way."""
        have = hierarchical_edges(self.segments).select("doc_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
        rows = pairs.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(have, ["doc_id", "lo", "hi"], "left_anti").drop("lo", "hi")
        for end in ("src", "dst"):
            rows = rows.join(self.segments.select("doc_id", F.col("seg_id").alias(end)), ["doc_id", end], "left_semi")
        return rows.select("doc_id", "src", "dst", "weight", F.lit("semantic_similarity").alias("type"))


def embedding_requests(segments: DataFrame) -> DataFrame:
    """doc_id, seg_id, content of all segments, for a text model."""
    return segments.select("doc_id", "seg_id", "content")


def sequential_edges(segments: DataFrame, symmetric: bool = False, weight: float = 1.0) -> DataFrame:
    """doc_id, src, dst, weight, type: each segment to its next sibling, and back if symmetric."""
    order = Window.partitionBy("doc_id", "parent_id", "rule_idx").orderBy("start_pos", "seg_id")
    rows = segments.filter("parent_id IS NOT NULL").select("doc_id", F.col("seg_id").alias("src"), F.lead("seg_id").over(order).alias("dst")).filter("dst IS NOT NULL")
    if symmetric:
        rows = rows.unionByName(rows.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return rows.select("doc_id", "src", "dst", F.lit(weight).alias("weight"), F.lit("sequential").alias("type"))


def children_view(segments: DataFrame) -> DataFrame:
    """doc_id, seg_id, children: of two rules' children those of the later one."""
    last = segments.filter("parent_id IS NOT NULL").withColumn("__r", F.max("rule_idx").over(Window.partitionBy("doc_id", "parent_id"))).filter("rule_idx = __r")
    return last.groupBy("doc_id", F.col("parent_id").alias("seg_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("seg_id").alias("s")))), lambda r: r["s"]).alias("children"))


def tree_stats(segments: DataFrame) -> DataFrame:
    """doc_id, total, depth, leaves, avg_branching (children for each segment that isn't on the last level), balance (share of a full binary tree)."""
    kids = segments.filter("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("seg_id")).agg(F.count("*").alias("n"))
    rows = segments.select("doc_id", "seg_id", "level").join(kids, ["doc_id", "seg_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = rows.groupBy("doc_id").agg(F.count("*").alias("total"), F.max("level").alias("depth"), F.sum((F.col("n") == 0).cast("long")).alias("leaves"), F.sum("n").alias("__links"))
    last = rows.withColumn("__d", F.max("level").over(Window.partitionBy("doc_id"))).filter("level < __d").groupBy("doc_id").agg(F.avg("n").alias("avg_branching"))
    return out.join(last, "doc_id", "left").select("doc_id", "total", "depth", "leaves", F.coalesce("avg_branching", F.lit(0.0)).alias("avg_branching"), (F.col("total") / (F.pow(F.lit(2.0), F.col("depth") + 1) - 1)).alias("balance"))


def nodes_by_level(segments: DataFrame) -> DataFrame:
    return segments.groupBy("doc_id", "level").agg(F.count("*").alias("nodes"))


def explains_edges(segments: DataFrame) -> DataFrame:
    """doc_id, src, dst, type, edge_type, weight: among siblings in order, the text just before a code segment explains it with 0.9, the text just
    after it with 0.7. Segments with mathematics but no code aren't siblings here."""
    order = Window.partitionBy("doc_id", "parent_id", "rule_idx").orderBy("start_pos", "seg_id")
    rows = segments.filter("parent_id IS NOT NULL AND (has_code OR NOT has_math)")
    rows = rows.withColumns({"p": F.lag("seg_id").over(order), "pc": F.lag("has_code").over(order), "n": F.lead("seg_id").over(order), "nc": F.lead("has_code").over(order)}).filter("has_code")
    edge = lambda c, w: rows.filter(f"{c} IS NOT NULL AND NOT {c}c").select("doc_id", F.col(c).alias("src"), F.col("seg_id").alias("dst"), F.lit("semantic").alias("type"), F.lit(1).alias("edge_type"), F.lit(w).alias("weight"))
    return edge("p", 0.9).unionByName(edge("n", 0.7))


def hierarchical_edges(segments: DataFrame) -> DataFrame:
    return segments.filter("parent_id IS NOT NULL").select("doc_id", F.col("parent_id").alias("src"), F.col("seg_id").alias("dst"), F.lit("hierarchical").alias("type"), F.lit(None).cast("int").alias("edge_type"), F.lit(None).cast("double").alias("weight"))


def level_layout(segments: DataFrame) -> DataFrame:
    """doc_id, seg_id, x, y: each level spread evenly over (-1, 1), y minus its depth."""
    own = Window.partitionBy("doc_id", "level")
    i = F.row_number().over(own.orderBy("seg_id"))
    return segments.select("doc_id", "seg_id", (i * 2 / (F.count("*").over(own) + 1) - 1).alias("x"), (-F.col("level")).alias("y"))


def subtree_sizes(segments: DataFrame) -> DataFrame:
    """doc_id, seg_id, size: itself and all below it, by the prefixes of its path."""
    part = F.split("seg_id", r"\.", -1)
    ups = F.transform(F.sequence(F.lit(1), F.size(part)), lambda k: F.array_join(F.slice(part, 1, k), "."))
    return segments.select("doc_id", F.explode(ups).alias("seg_id")).groupBy("doc_id", "seg_id").agg(F.count("*").alias("size"))


def unprocessed(segments: DataFrame, processed: DataFrame, rule_idx: int) -> DataFrame:
    """Segments that a rule hasn't processed yet; processed: doc_id, seg_id, rule_idx."""
    return segments.join(processed.filter(F.col("rule_idx") == rule_idx).select("doc_id", "seg_id"), ["doc_id", "seg_id"], "left_anti")


def fully_processed(segments: DataFrame, processed: DataFrame, rules: int) -> DataFrame:
    """Segments that all of the rules have processed."""
    done = processed.groupBy("doc_id", "seg_id").agg(F.count_distinct("rule_idx").alias("n")).filter(F.col("n") >= rules)
    return segments.join(done.select("doc_id", "seg_id"), ["doc_id", "seg_id"], "left_semi")

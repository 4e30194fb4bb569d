"""Attention between the tokens of a text, and segmentation by it.

Without a model, a token attends to earlier tokens of its band whose surroundings are like its own. Layers differ in how far they look back, heads in how
much of the surroundings counts. Cells come from one pass over a text's tokens in order that compares each with those of its band, so a text of n tokens costs at most n times the
band, never n squared, and no pair of words is shuffled. A real model's cells, in the same columns, can take their place: attn (doc_id, layer, head, i, j, w), j before i.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators import align, attention, segment, tree
from loomspark.operators.graph import dense_threshold

BANDS, RADII = (16, 64), (0, 1)


def _placed_words(text: Column) -> Column:
    """Array of (tok, begin, end) of each white-space separated word."""
    return F.filter(align.joined_places(F.split(text, r"(?U)\s", -1)), lambda t: t["tok"] != "")


def tokens_of(docs: DataFrame) -> DataFrame:
    """doc_id, tok_idx, word, begin, end of each white-space separated word, by its place in the text. A text's tokens follow each other in one partition."""
    rows = docs.select("doc_id", F.posexplode(_placed_words(F.col("text"))).alias("k", "t"))
    return rows.select("doc_id", F.col("k").cast("long").alias("tok_idx"), F.lower("t.tok").alias("word"), F.col("t.begin").alias("begin"), F.col("t.end").alias("end"))


def _tokens_in_pieces(docs: DataFrame, rule: segment.Segmenter) -> DataFrame:
    """tokens_of plus seg: the number of the last piece of located_pieces that holds the token, null where none does. Both come from the same row."""
    segs = F.transform(tree.located(F.col("text"), rule(F.col("text"))), lambda p, k: F.struct(k.alias("seg_idx"), p["at"].alias("begin"), (p["at"] + F.length(p["piece"])).alias("end")))
    rows = docs.select("doc_id", _placed_words(F.col("text")).alias("t"), segs.alias("s"))
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip("t", align.interval_hits(F.col("t"), F.col("s")).alias("h"))).alias("k", "x"))
    return rows.select("doc_id", F.col("k").cast("long").alias("tok_idx"), F.lower("x.t.tok").alias("word"), F.when(F.col("x.h.n_segs") > 0, F.col("x.h.seg_idx").cast("int")).alias("seg"))


def _compared(bands: tuple[int, ...], radii: tuple[int, ...]):
    band, ahead = max(bands), max(radii)

    def cells(t: pa.Table, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        """The cells of the tokens begin to end of t, which holds what they meet before and behind."""
        doc, word = (t[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("doc_id", "word"))
        at, own, segs = t["tok_idx"].to_numpy(), slice(begin, end), "seg" in t.column_names
        apart = np.arange(1, band + 1)[:, None]
        equal = np.zeros((band, len(doc)), bool)
        for d in range(1, min(band, len(doc) - 1) + 1):
            equal[d - 1, d:] = (word[d:] == word[:-d]) & (doc[d:] == doc[:-d])
        inside = apart <= at[own][None, :]
        for head, r in enumerate(radii):
            same = np.zeros((band, end - begin), np.int64)
            for shift in range(-r, r + 1):
                low, high = max(0, -begin - shift), min(end, len(doc) - shift) - begin
                if low < high:
                    near = slice(begin + low + shift, begin + high + shift)
                    same[:, low:high] += equal[:, near] & (doc[near] == doc[begin + low : begin + high])
            score = np.where(inside, same, 0) / (2 * r + 1)
            for layer, b in enumerate(bands):
                of = score[:b]
                k, d = np.nonzero(of.T)
                w = of[d, k] / (1 + of.sum(axis=0))[k]
                i, k = at[own][k], k + begin
                row = [t["doc_id"].take(pa.array(k)).combine_chunks(), *(pa.array(np.full(len(k), x, np.int32)) for x in (layer, head)), pa.array(i), pa.array(i - d - 1), pa.array(w)]
                if segs:
                    row += [t["seg"].take(pa.array(x)).combine_chunks() for x in (k, k - d - 1)]
                yield pa.record_batch(row, ["doc_id", "layer", "head", "i", "j", "w", *(["si", "sj"] if segs else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's tokens in order. Only the last band of them is held from one batch to the next."""
        held, begin = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            end = held.num_rows - ahead
            if end > begin:
                yield from cells(held, begin, end)
                first = max(0, end - band - ahead)
                held, begin = held.slice(first), end - first
        if held is not None and held.num_rows > begin:
            yield from cells(held, begin, held.num_rows)

    return run


def banded_attention(tokens: DataFrame, bands: tuple[int, ...] = BANDS, radii: tuple[int, ...] = RADII, ordered: bool = False) -> DataFrame:
    """doc_id, layer, head, i, j, w: layer k looks at the bands[k] tokens before, head h compares the words within radii[h] places.

    A cell's score is the share of equal words in the two surroundings; w is the score over 1 plus all scores of its row, the 1 being the token itself. Cells
    of score 0 are absent. tokens: doc_id, tok_idx (from 0, without gaps), word; with seg, cells have si and sj, the seg of i and of j. ordered: each text's tokens already follow
    each other in one partition, as tokens_of gives them; else they are dealt by doc_id and sorted. Tokens then stream through their task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    seg = ["seg"] if "seg" in kinds else []
    rows = tokens.filter("doc_id IS NOT NULL AND word IS NOT NULL").select("doc_id", F.col("tok_idx").cast("long").alias("tok_idx"), "word", *seg)
    rows = rows if ordered else rows.repartition("doc_id").sortWithinPartitions("doc_id", "tok_idx")
    return rows.mapInArrow(_compared(bands, radii), f"doc_id {kinds['doc_id']}, layer int, head int, i long, j long, w double" + (f", si {kinds['seg']}, sj {kinds['seg']}" if seg else ""))


def _later_weigh_more(layers: int) -> tuple[Column, float]:
    return 1 + F.col("layer") / F.lit(layers), sum(1 + k / layers for k in range(layers))


def text_flow(attn: DataFrame, tokens: DataFrame, layers: int = len(BANDS), heads: int = len(RADII)) -> DataFrame:
    """doc_id, i, flow (to 9 decimals) of every token: attention to earlier ones, mean over heads and over layers, later ones weighing more; 0 without any."""
    weight, total = _later_weigh_more(layers)
    sums = attn.filter("j < i").groupBy("doc_id", "i").agg((F.sum(F.col("w") * weight) / (total * heads)).alias("flow"))
    every = tokens.select("doc_id", F.col("tok_idx").cast("long").alias("i"))
    return every.join(sums, ["doc_id", "i"], "left").select("doc_id", "i", F.round(F.coalesce("flow", F.lit(0.0)), 9).alias("flow"))


def text_boundaries(flows: DataFrame, threshold: float = 0.3, least: float = 0.2) -> DataFrame:
    """doc_id, position (a token), strength, type, n: where the flow drops or peaks, drops and peaks of one place taken together, of those over least."""
    rows = flows.withColumnRenamed("doc_id", "window_idx")
    found = attention.drops(rows, threshold).unionByName(attention.peaks(rows, threshold)).withColumn("strength", F.round("strength", 9))
    return attention.consolidate(found.withColumnRenamed("window_idx", "doc_id"), least, ["doc_id", "position"])


def segment_by_attention(docs: DataFrame, threshold: float = 0.3, least: float = 0.2, attn: DataFrame | None = None) -> DataFrame:
    """doc_id, ord, start_pos, content: the texts cut where their own attention drops or peaks, at the places of those tokens; pieces stripped, blank ones dropped.

    attn: cells of a model, instead of those from the text. A text without boundaries is one piece; a null text gives none. doc_id should be unique.
    """
    tokens = tokens_of(docs)
    cells = banded_attention(tokens, ordered=True) if attn is None else attn
    found = text_boundaries(text_flow(cells, tokens), threshold, least)
    return segment.cut_at_tokens(docs, found.select("doc_id", "position"), tokens)


def located_pieces(docs: DataFrame, rule: segment.Segmenter = segment.paragraphs) -> DataFrame:
    """doc_id, ord, content, begin, end: a rule's pieces at their places in the text."""
    at = docs.select("doc_id", F.posexplode(tree.located(F.col("text"), rule(F.col("text")))).alias("ord", "p"))
    return at.select("doc_id", "ord", F.col("p.piece").alias("content"), F.col("p.at").alias("begin"), (F.col("p.at") + F.length("p.piece")).alias("end"))


def node_attention(attn: DataFrame, tokens: DataFrame, pieces: DataFrame, heads: int = len(RADII)) -> DataFrame:
    """doc_id, layer, i, j, w: token attention pooled to pieces (doc_id, ord, begin, end): the mean over all cells of a block, absent ones 0, and over heads.

    Tokens meet their piece by bins of positions; a token that reaches into several is of the last, one outside of all of none.
    """
    inside = align.interval_map(tokens, pieces.select("doc_id", F.col("ord").alias("seg_idx"), "begin", "end")).filter("n_segs > 0").select("doc_id", F.col("tok_idx").cast("long").alias("tok"), "seg_idx")
    a, b = (inside.select("doc_id", F.col("tok").alias(x), F.col("seg_idx").alias(f"s{x}")) for x in ("i", "j"))
    return _pooled(attn.join(a, ["doc_id", "i"]).join(b, ["doc_id", "j"]), inside, heads)


def _pooled(cells: DataFrame, inside: DataFrame, heads: int = len(RADII)) -> DataFrame:
    """node_attention of cells with si and sj, the pieces of their ends, where inside has a row (doc_id, seg_idx) for each token of a piece. Cells are added up where they lie."""
    sizes = inside.groupBy("doc_id", "seg_idx").agg(F.count("*").alias("k"))
    sums = cells.groupBy("doc_id", "layer", F.col("si").alias("i"), F.col("sj").alias("j")).agg(F.sum("w").alias("w"))
    of = lambda x: sizes.select("doc_id", F.col("seg_idx").alias(x), F.col("k").alias(f"k{x}"))
    rows = sums.join(of("i"), ["doc_id", "i"]).join(of("j"), ["doc_id", "j"])
    return rows.select("doc_id", "layer", "i", "j", (F.col("w") / (F.col("ki") * F.col("kj") * heads)).alias("w"))


def piece_graph(nodes: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, i, j, weight (summed over layers), linked: over the mean plus deviation of all n * n cells of the text, absent ones 0."""
    w = nodes.groupBy("doc_id", "i", "j").agg(F.round(F.sum("w"), 9).alias("w"))
    n = pieces.groupBy("doc_id").agg(F.count("*").alias("n"))
    sized = w.join(n, "doc_id")
    limit = dense_threshold(sized, F.max("n"), ["doc_id"])
    return w.join(limit, "doc_id").select("doc_id", "i", "j", F.col("w").alias("weight"), (F.col("w") > F.round("threshold", 9)).alias("linked"))


def segment_with_dual_attention(docs: DataFrame, rule: segment.Segmenter = segment.paragraphs, refine=lambda pieces, graph: pieces, attn: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two levels at once: (pieces, graph). pieces: doc_id, ord, content, start_pos and end_pos as if joined again by one character, links (numbers of the
    pieces that it attends to by more than mean plus deviation, in order); graph: as piece_graph.

    The rule cuts, tokens attend, pieces get their attention by pooling, refine may change pieces by the graph. A text of one piece has no graph.
    """
    pieces = located_pieces(docs, rule)
    if attn is None:  # a token knows its piece, so cells need no join with the tokens
        tokens = _tokens_in_pieces(docs, rule)
        nodes = _pooled(banded_attention(tokens, ordered=True).filter("si IS NOT NULL AND sj IS NOT NULL"), tokens.filter("doc_id IS NOT NULL AND seg IS NOT NULL").select("doc_id", F.col("seg").alias("seg_idx")))
    else:
        nodes = node_attention(attn, tokens_of(docs), pieces)
    graph = piece_graph(nodes, pieces)
    links = graph.filter("linked AND i <> j").groupBy("doc_id", F.col("i").alias("ord")).agg(F.array_sort(F.collect_list("j")).alias("links"))
    out = segment.with_positions(pieces.select("doc_id", "ord", "content")).join(links, ["doc_id", "ord"], "left")
    out = out.withColumn("links", F.coalesce("links", F.array().cast("array<int>")))
    return refine(out, graph), graph

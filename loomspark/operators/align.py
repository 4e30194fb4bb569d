"""Alignment of tokens with segments and windows.

Null texts or token lists give nothing; tokens that no segment holds map to 0; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def clean_token(token: Column, kind: str = "auto") -> Column:
    """Sub-word marks of word-piece, sentence-piece and byte-level vocabularies; auto strips and keeps the raw token where nothing is left."""
    bare = F.replace(token, F.lit("##"), F.lit("")) if kind in ("wordpiece", "auto") else token
    bare = F.replace(bare, F.lit("▁"), F.lit(" ")) if kind in ("sentencepiece", "auto") else bare
    bare = F.replace(bare, F.lit("Ġ"), F.lit(" ")) if kind in ("bpe", "auto") else bare
    return F.when(F.trim(bare) == "", token).otherwise(F.trim(bare)) if kind == "auto" else bare


def _find_tokens(text: str | None, tokens: list | None) -> list | None:
    """(tok, begin, end) of each token from one cursor."""
    if tokens is None:
        return None
    out, cur = [], 0
    for t in tokens:
        begin = end = cur
        if t is not None and text is not None and not (t.startswith("[") and t.endswith("]")):
            bare = t.replace("##", "").replace("▁", " ").replace("Ġ", " ").strip(" ")
            clean = bare or t
            at = text.find(clean, cur) if clean else 0
            if at >= 0:
                begin, end = at, at + len(clean)
        out.append((t, begin, end))
        cur = end
    return out


def token_positions(text: Column, tokens: Column) -> Column:
    """Array of (tok, begin, end) by search from the end of the one before; special [X] tokens and misses have no width at the cursor. A search goes on where the last
    one ended, so a text costs its length, not its length times its tokens."""
    kind = ArrayType(StructType([StructField("tok", StringType()), StructField("begin", IntegerType()), StructField("end", IntegerType())]))

    @F.arrow_udf(kind)
    def found(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = (_find_tokens(x.as_py(), t.as_py()) for x, t in zip(texts, lists))
        rows = [r if r is None else [{"tok": t, "begin": b, "end": e} for t, b, e in r] for r in rows]
        return pa.array(rows, pa.list_(pa.struct([("tok", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])))

    return found(text, tokens)


def _offsets(lists: pa.Array) -> np.ndarray:
    """Where each row begins in lists.flatten(), and its end; a null row is empty."""
    return np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))].astype(np.int64)


def joined_places(words: Column) -> Column:
    """Array of (tok, begin, end) of an array of words without nulls, as if joined by one character. A row is worked on by itself, so no window orders its words."""

    @F.arrow_udf("array<struct<tok:string,begin:bigint,end:bigint>>")
    def placed(rows: pa.Array) -> pa.Array:
        at, toks = _offsets(rows), rows.flatten()
        size = pc.utf8_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.r_[0, np.cumsum(size + 1)]
        begin = ends[:-1] - np.repeat(ends[at[:-1]], np.diff(at))
        each = pa.StructArray.from_arrays([toks, pa.array(begin), pa.array(begin + size)], ["tok", "begin", "end"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), each)

    return placed(words)


def _bins(row: np.ndarray, begin: np.ndarray, end: np.ndarray, bin_size: int) -> tuple[np.ndarray, ...]:
    """Each range's (row, bin) as one key for every bin that it touches, its number, and the first of its bins."""
    first = begin // bin_size
    count = np.maximum(end - 1, begin) // bin_size - first + 1
    of = np.repeat(np.arange(len(row)), count)
    return row[of] << 32 | (first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)), of, first


def _overlapped(row: np.ndarray, begin: np.ndarray, end: np.ndarray, seg_row: np.ndarray, seg: np.ndarray, sb: np.ndarray, se: np.ndarray, bin_size: int, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """For tokens (row, begin, end) the largest seg of the segments of their row that they overlap (0 without any), and how many these are. Both meet by bins."""
    keys, of, first = _bins(seg_row, sb, se, bin_size)
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    best, n = np.full(len(row), np.iinfo(np.int64).min), np.zeros(len(row), np.int64)
    for k in range(0, len(row), most):
        part = slice(k, k + most)
        met, tok, tok_first = _bins(row[part], begin[part], end[part], bin_size)
        low = np.searchsorted(keys, met)
        count = np.searchsorted(keys, met, "right") - low
        bin_, t = np.repeat(met & 0xFFFFFFFF, count), np.repeat(tok, count)
        s = of[np.arange(len(t)) + np.repeat(low - np.cumsum(count) + count, count)]
        # a pair that shares several bins counts in the first of them
        hit = (begin[part][t] < se[s]) & (end[part][t] > sb[s]) & (bin_ == np.maximum(tok_first[t], first[s]))
        np.maximum.at(best, t[hit] + k, seg[s[hit]])
        n += np.bincount(t[hit] + k, minlength=len(row))
    return np.where(n > 0, best, 0), n


def interval_hits(tokens: Column, segments: Column, bin_size: int = 256) -> Column:
    """interval_map where a row holds a text's tokens, array of (begin, end, ...), and segments, array of (seg_idx, begin, end), positions from 0 and none null: array of (seg_idx, n_segs)
    in the order of the tokens. Nothing leaves its row, so nothing is shuffled."""

    @F.arrow_udf("array<struct<seg_idx:bigint,n_segs:bigint>>")
    def found(begins: pa.Array, ends: pa.Array, segs: pa.Array, sbs: pa.Array, ses: pa.Array) -> pa.Array:
        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at, seg_at = _offsets(begins), _offsets(segs)
        rows = np.arange(len(begins))
        best, n = _overlapped(np.repeat(rows, np.diff(at)), flat(begins), flat(ends), np.repeat(rows, np.diff(seg_at)), flat(segs), flat(sbs), flat(ses), bin_size)
        each = pa.StructArray.from_arrays([pa.array(best), pa.array(n)], ["seg_idx", "n_segs"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), each)

    longs = lambda c, f: F.transform(c, lambda x: x[f].cast("long"))
    return found(longs(tokens, "begin"), longs(tokens, "end"), longs(segments, "seg_idx"), longs(segments, "begin"), longs(segments, "end"))


def _window_hits(step: int, span: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, sizes of its words) word by word, at most `most` words at once, also within a long text."""
        for batch in batches:
            offsets, sizes = _offsets(batch.column(1)), batch.column(1).flatten()
            base = 0  # where the text that goes on from the slice before stands
            for low in range(0, len(sizes), most):
                at = np.arange(low, min(low + most, len(sizes)))
                row = np.searchsorted(offsets, at, "right") - 1
                size = sizes.slice(low, len(at)).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(size + 1)
                first = np.maximum(offsets[row], low) - low  # the text's first word of the slice
                begin = ends - size - 1 - (ends[first] - size[first] - 1)
                begin[row == row[0]] += base if offsets[row[0]] < low else 0
                end = begin + size
                base = int(end[-1]) + 1
                last, least = -(-end // step) - 1, np.maximum((begin - span) // step + 1, 0)
                n = np.maximum(last - least + 1, 0)
                ids = batch.column(0).take(pa.array(row))
                yield pa.record_batch([ids, pa.array(at - offsets[row]), pa.array(np.where(n > 0, last, 0)), pa.array(n)], ["doc_id", "tok_idx", "seg_idx", "n_segs"])

    return run


def window_hits(rows: DataFrame, doc_id: str, words: Column, step: int, span: int, most: int = 1 << 17) -> DataFrame:
    """doc_id, tok_idx, seg_idx, n_segs: interval_map of each text's words, as if joined by one character, with the windows of `span` characters that begin every `step` (at most span) of them.
    The windows that a word overlaps follow from where it stands, so only the words' sizes leave the text, and a task holds a batch of these and a slice of results. Null words are left out."""
    sizes = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.transform(F.filter(words, lambda w: w.isNotNull()), lambda w: F.length(w)).alias("sizes"))
    return sizes.mapInArrow(_window_hits(step, span, most), "doc_id long, tok_idx long, seg_idx long, n_segs long")


def interval_map(tokens: DataFrame, segments: DataFrame, bin_size: int = 1024) -> DataFrame:
    """doc_id, tok_idx, seg_idx, n_segs: the last segment that each token overlaps, 0 where none does.

    tokens: doc_id, tok_idx, begin, end; segments: doc_id, seg_idx, begin, end; half-open. Both meet by bins of positions, and a pair that shares several bins
    counts in the first of them, so one join and one aggregation with partial sums do it. Rows that repeat a token are one; a token without a position overlaps none.
    """
    first = lambda: F.floor(F.col("begin") / bin_size)
    bins = lambda df: df.withColumns({"first": first(), "bin": F.explode_outer(F.sequence(first(), F.floor(F.greatest(F.col("end") - 1, F.col("begin")) / bin_size)))})
    s = bins(segments.select("doc_id", "seg_idx", "begin", "end")).withColumnsRenamed({"begin": "sb", "end": "se", "first": "sf"})
    met = bins(tokens.select("doc_id", "tok_idx", "begin", "end")).join(s, ["doc_id", "bin"], "left")
    hit = F.when((F.col("begin") < F.col("se")) & (F.col("end") > F.col("sb")) & (F.col("bin") == F.greatest("first", "sf")), F.col("seg_idx"))
    return met.groupBy("doc_id", "tok_idx").agg(F.max(hit).alias("seg_idx"), F.count(hit).alias("n_segs")).na.fill(0, ["seg_idx", "n_segs"])


def uniform_map(tokens: DataFrame, k: int) -> DataFrame:
    """seg_idx without positions: k runs of equal length, the first of them one longer where it doesn't come out even."""
    return tokens.withColumn("seg_idx", F.ntile(k).over(Window.partitionBy("doc_id").orderBy("tok_idx")) - 1)


def uniform_levels(tokens: DataFrame, ks: list[int]) -> DataFrame:
    """doc_id, tok_idx, levels: each token's seg_idx of uniform_map at each number of runs, a map from its place in ks. One sort of the tokens' places serves all
    levels, and nothing is gathered by token."""
    w = Window.partitionBy("doc_id").orderBy("tok_idx")
    rows = tokens.select("doc_id", "tok_idx", *[(F.ntile(k).over(w) - 1).alias(f"__{i}") for i, k in enumerate(ks)])
    levels = F.map_from_arrays(F.array(*[F.lit(i) for i in range(len(ks))]), F.array(*[F.col(f"__{i}") for i in range(len(ks))]))
    return rows.select("doc_id", "tok_idx", levels.alias("levels"))


def window_slice(mapping: DataFrame, start: int, size: int) -> DataFrame:
    """doc_id, pos (0 to size - 1), seg_idx: a window of the mapping, 0 past its end."""
    own = mapping.filter((F.col("tok_idx") >= start) & (F.col("tok_idx") < start + size)).select("doc_id", (F.col("tok_idx") - start).alias("pos"), "seg_idx")
    every = mapping.select("doc_id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return every.join(own, ["doc_id", "pos"], "left").na.fill(0, ["seg_idx"])


def tracked_segments(decisions: DataFrame) -> DataFrame:
    """doc_id, seg, begin, end from (doc_id, tok_idx, seg) decisions: each segment's span; those between without tokens are empty at 0."""
    spans = decisions.groupBy("doc_id", "seg").agg(F.min("tok_idx").alias("begin"), (F.max("tok_idx") + 1).alias("end"))
    every = decisions.groupBy("doc_id").agg(F.max("seg").alias("m")).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("seg"))
    return every.join(spans, ["doc_id", "seg"], "left").na.fill(0, ["begin", "end"])


def segment_mask(mapping: DataFrame, seg: int) -> DataFrame:
    """mapping plus in_segment: whether the token is of that segment; a token without a segment isn't."""
    return mapping.withColumn("in_segment", F.coalesce(F.col("seg_idx") == seg, F.lit(False)))


def multi_level(mapping: DataFrame) -> DataFrame:
    """doc_id, tok_idx, levels: each token's segments by level, a map, from rows (doc_id, tok_idx, level, seg_idx) of distinct levels."""
    return mapping.groupBy("doc_id", "tok_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "seg_idx")))).alias("levels"))

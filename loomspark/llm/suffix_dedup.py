"""Suffix-array dedup: remove every byte that a string of `length` bytes covers which also starts anywhere else.

Only some suffixes are indexed. Every window of `length` bytes picks the smallest hash among its strings of ANCHOR bytes; equal
windows pick the same place, their anchor, so it is enough to compare what surrounds anchors with equal strings. Windows in
a row with one anchor make a segment. Segments are counted by two hashes; a segment whose anchor string is nowhere else
is done with, and one whose whole text is elsewhere is repeated as a whole, so copies collapse before anything is sorted. The rest,
mostly the ends of shared passages, goes to suffix arrays: an index family for each slice of the anchor strings. A batch's
segments are sorted by the text from the anchor on and by the text before it, read backwards; arrays of equal size are merged,
and the scan of the merged arrays marks the windows for which some other segment agrees far enough both ways.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from loomspark.llm.common import Scratch, hot_split_join, keyed, text_bytes, trim
from loomspark.llm.near_dedup import _may_be_in

ANCHOR = 64  # bytes of an anchor's string; at most half of length
CHUNK = 1 << 19  # bytes hashed at once
PLACE = np.uint64((1 << 24) - 1)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd
FAMILY_ROWS, GROUP_ROWS = 20_000, 20_000  # segments of an index family on average; of one anchor string at most


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Polynomial hashes, modulo 2^64, of any stretches of up to `most` bytes."""

    def __init__(self, multiplier: int, most: int):
        inverse = pow(multiplier, -1, 1 << 64)
        self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(most, x, np.uint64)]) for x in (multiplier, inverse))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def segments_of(data: np.ndarray, valid: np.ndarray, hashers: tuple[Hasher, Hasher], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor's place, hash of the anchor's string, hash of all that the windows cover) of each segment of data.

    valid marks the places where a window starts that lies in one text.
    """
    n = len(data)
    if n < length or not valid.any():
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    sums = hashers[0].sums(data)
    grams = _mixed((sums[anchor:] - sums[:-anchor]) * hashers[0].down[: n - anchor + 1])
    low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)  # ties go to the first place
    width, span = length - anchor + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = np.flatnonzero(valid[: len(low)])
    place = (low[at] & PLACE).astype(np.int64)
    breaks = np.flatnonzero((np.diff(place) != 0) | (np.diff(at) != 1)) + 1
    first, last = np.r_[0, breaks], np.r_[breaks - 1, len(at) - 1]
    start, end, place = at[first], at[last], place[first]
    whole = hashers[1].of(hashers[1].sums(data), start, end + length)
    shape = ((place - start) * 4096 + (end - start)).astype(np.uint64)
    return start, end, place, grams[place], _mixed(whole + _mixed(shape + np.uint64(1)))


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Texts laid end to end in chunks, and (text, its place in the chunk, its offset there) of each; a long text is cut, with length - 1 bytes in common."""
    held, parts, size = [], [], 0
    for k, t in enumerate(texts):
        for lo in range(0, len(t) - length + 1, CHUNK):
            piece = t[lo : lo + CHUNK + length - 1]
            if size and size + len(piece) > CHUNK + length:
                yield b"".join(held), parts
                held, parts, size = [], [], 0
            parts.append((k, size, lo))
            held.append(piece)
            size += len(piece)
    if held:
        yield b"".join(held), parts


def _segments_in(length: int, anchor: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = tuple(Hasher(m, CHUNK + length) for m in MULTIPLIERS)
        for b in batches:
            ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
            for data, parts in _chunks([t.as_py() for t in b.column(2)], length):
                data = np.frombuffer(data, np.uint8)
                owner, place, offset = (np.array(c, np.int64) for c in zip(*parts))
                ends = np.r_[place[1:], len(data)]
                valid = np.zeros(len(data) + 1, np.int8)
                valid[place], valid[ends - length + 1] = 1, -1
                start, end, at, fp, whole = segments_of(data, valid.cumsum()[:-1] > 0, hashers, length, anchor)
                part = np.searchsorted(place, start, "right") - 1
                row, shift = owner[part], offset[part] - place[part]
                columns = [ids[row], hashes[row], start + shift, (end - start).astype(np.int32), (at - start).astype(np.int32), fp.view(np.int64), whole.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "th", "start", "more", "ahead", "fp", "h"])
            del b
            trim()

    return segments


class Array:
    """A suffix array of segments: `right` orders them by the text from their anchors on, `left` by the text before them, backwards."""

    def __init__(self, rows: np.ndarray, ahead: np.ndarray, behind: np.ndarray, right: np.ndarray, left: np.ndarray, seen: np.ndarray):
        self.rows, self.ahead, self.behind, self.right, self.left, self.seen = rows, ahead, behind, right, left, seen

    @classmethod
    def of_batch(cls, first: int, texts: list[bytes], at: list[int], more: list[int], repeated: list[bool], length: int, anchor: int) -> Array:
        """ahead and behind: the texts on either side of the anchors, padded; seen: of each window, by the bytes before the anchor, whether it is repeated
        (1), not known to be (0), or none of the segment's (-1)."""
        ahead = np.array([t[a : a + length].ljust(length, b"\0") for t, a in zip(texts, at)], f"S{length}")
        behind = np.array([t[:a][::-1].ljust(length - anchor, b"\0") for t, a in zip(texts, at)], f"S{length - anchor}")
        before = np.arange(length - anchor + 1)
        most, least = np.array(at)[:, None], (np.array(at) - np.array(more))[:, None]
        seen = np.where((before <= most) & (before >= least), np.array(repeated, np.int8)[:, None], np.int8(-1))
        return cls(np.arange(first, first + len(texts)), ahead, behind, np.argsort(ahead, kind="stable"), np.argsort(behind, kind="stable"), seen)


def _merged_order(a: np.ndarray, b: np.ndarray, a_order: np.ndarray, b_order: np.ndarray) -> np.ndarray:
    """The order of a's rows followed by b's, from the orders of both."""
    place = np.searchsorted(a[a_order], b[b_order], "right") + np.arange(len(b))
    out = np.empty(len(a) + len(b), np.int64)
    of_a = np.ones(len(out), bool)
    of_a[place] = False
    out[place], out[of_a] = b_order + len(a), a_order
    return out


def _common(texts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of what each text has in common with the one before it in order; 0 for the first."""
    bytes_ = texts.view(np.uint8).reshape(len(texts), texts.dtype.itemsize)
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 8192):
        hi = min(len(order), lo + 8192)
        differ = bytes_[order[lo - 1 : hi - 1]] != bytes_[order[lo:hi]]
        out[lo:hi] = np.where(differ.any(1), differ.argmax(1), texts.dtype.itemsize)
    return out


def mark(array: Array, length: int) -> None:
    """Marks the windows that stand in two segments of the array: those whose neighbours in both orders agree far enough form the same two classes."""
    n = len(array.rows)
    right, left = _common(array.ahead, array.right), _common(array.behind, array.left)
    of_right, of_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(array.seen.shape[1]):
        here = np.flatnonzero(array.seen[:, before] >= 0)
        if len(here) < 2:
            continue
        of_right[array.right] = np.cumsum(right < length - before)
        of_left[array.left] = np.cumsum(left < before) if before else 0
        both = of_right[here] * (n + 1) + of_left[here]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        array.seen[here[order[np.r_[False, same] | np.r_[same, False]]], before] = 1


def merge(a: Array, b: Array, length: int) -> Array:
    right, left = _merged_order(a.ahead, b.ahead, a.right, b.right), _merged_order(a.behind, b.behind, a.left, b.left)
    out = Array(*(np.concatenate([getattr(a, x), getattr(b, x)]) for x in ("rows", "ahead", "behind")), right, left, np.concatenate([a.seen, b.seen]))
    mark(out, length)
    return out


class Family:
    """Arrays of falling size. A new batch's array is merged with the last while that isn't larger, so each segment is merged a logarithmic number of times,
    and any two of them meet at least once."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor, self.levels, self.rows = length, anchor, [], 0

    def add(self, texts: list[bytes], at: list[int], more: list[int], repeated: list[bool]) -> None:
        if not texts:
            return
        new = Array.of_batch(self.rows, texts, at, more, repeated, self.length, self.anchor)
        mark(new, self.length)
        self.rows += len(texts)
        while self.levels and len(self.levels[-1].rows) <= len(new.rows):
            new = merge(self.levels.pop(), new, self.length)
        self.levels.append(new)

    def windows(self) -> np.ndarray:
        """seen of all segments, in the order they came."""
        while len(self.levels) > 1:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(merge(a, b, self.length))
        if not self.levels:
            return np.empty((0, self.length - self.anchor + 1), np.int8)
        last = self.levels[0]
        out = np.empty_like(last.seen)
        out[last.rows] = last.seen
        return out


def _spans(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags, 0]))
    return [{"lo": int(a), "hi": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


SPANS = "array<struct<lo:int,hi:int>>"
SPANS_ARROW = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _family_in(length: int, anchor: int):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, kinds, shapes = Family(length, anchor), [], []
        for b in batches:
            ahead, more, n = (b.column(x).to_pylist() for x in ("ahead", "more", "n"))
            family.add(b.column("bytes").to_pylist(), ahead, more, [x > 1 for x in n])
            kinds.append(b.select(["fp", "h"]))
            shapes += zip(ahead, more)
        seen = family.windows()
        del family
        # window j starts j bytes after the segment, ahead - j before its anchor
        found = [_spans((seen[k, ahead - more : ahead + 1] == 1)[::-1].astype(np.int8)) for k, (ahead, more) in enumerate(shapes)]
        at = 0
        for b in kinds:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found[at : at + b.num_rows], SPANS_ARROW)], ["fp", "h", "spans"])
            at += b.num_rows
        del seen, found, kinds
        trim()

    return indexed


def _windows_udf(length: int):
    """Two hashes of each window of a segment."""

    @F.arrow_udf("array<struct<a:long,b:long>>")
    def windows(texts: pa.Array) -> pa.Array:
        hashers = tuple(Hasher(m, 2 * length) for m in MULTIPLIERS)
        a, b, offsets = [], [], [0]
        for t in texts:
            data = np.frombuffer(t.as_py(), np.uint8)
            start = np.arange(len(data) - length + 1)
            for out, x in zip((a, b), hashers):
                out.append(_mixed(x.of(x.sums(data), start, start + length)).view(np.int64))
            offsets.append(offsets[-1] + len(start))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], ["a", "b"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return windows


@F.arrow_udf(ArrayType(BinaryType()))
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The stretches [at, at + size) of each text."""
    out = []
    for t, s in zip(texts, spans):
        t = t.as_py()
        out.append([t[x["at"] : x["at"] + x["size"]] for x in s.as_py()])
    return pa.array(out, pa.list_(pa.binary()))


def _keep_udf(length: int):
    @F.arrow_udf("struct<kept:binary,n_bytes:long,n_removed:long,n_spans:long>")
    def keep(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        kept, sizes, removed, spans = [], [], [], []
        for t, r in zip(texts, ranges):
            t, r = t.as_py(), r.as_py()
            gone, runs, end, stay = 0, 0, 0, []
            for lo, hi in sorted((x["lo"], x["hi"] + length) for x in r or ()):
                if lo > end or not runs:
                    stay.append(t[end:lo])
                    runs, gone, end = runs + 1, gone + hi - lo, hi
                elif hi > end:
                    gone, end = gone + hi - end, hi
            kept.append(b"".join([*stay, t[end:]]) if runs else t)
            sizes.append(len(t))
            removed.append(gone)
            spans.append(runs)
        columns = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans))]
        del kept
        trim()
        return pa.StructArray.from_arrays(columns, ["kept", "n_bytes", "n_removed", "n_spans"])

    return keep


def _by_windows(rows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(fp, h, spans) of segments whose anchor string more segments share than a family should hold: their windows are counted by two hashes, equal ones on
    the way to the shuffle, so no task holds such a group."""
    each = rows.select("fp", "h", "n", F.posexplode(_windows_udf(length)("bytes")).alias("j", "w")).select("fp", "h", "n", "j", "w.a", "w.b")
    each = scratch.write(each, "windows")
    shared = scratch.write(each.groupBy("a", "b").agg(F.sum("n").alias("all"), F.count("*").alias("rows")).filter("all > 1").select("a", F.col("b").alias("b2"), "rows"), "shared-windows")
    hits = hot_split_join(each, shared, "a", "rows").filter("b = b2")
    return hits.groupBy("fp", "h").agg(F.collect_list(F.struct(F.col("j").cast("int").alias("lo"), F.col("j").cast("int").alias("hi"))).alias("spans"))


def _repeats(docs: DataFrame, length: int, anchor: int, scratch: Scratch, filter_bits: int, family_rows: int, group_rows: int) -> DataFrame:
    """(id, th, ranges) of the rows of docs (id, th, text) that hold repeated windows: the places where they start, as [lo, hi]."""
    fields = "id long, th long, start long, more int, ahead int, fp long, h long"
    segments = scratch.write(docs.mapInArrow(_segments_in(length, anchor), fields), "segments")
    # copies of a segment meet on the way to the shuffle
    shared = segments.groupBy("fp", "h").agg(F.count("*").alias("n")).groupBy("fp").agg(F.sum("n").alias("rows"), F.count("*").alias("kinds")).filter("rows > 1")
    shared = scratch.write(shared, "shared")
    found = scratch.write(hot_split_join(segments.filter(_may_be_in(shared, "fp", filter_bits)), shared, "fp", "rows"), "found")
    scratch.drop("segments", "shared")

    whole = F.struct(F.lit(0).alias("lo"), F.col("more").alias("hi"))
    ranges = [found.filter("kinds = 1").select("id", "th", "start", F.array(whole).alias("spans"))]
    open_ = found.filter("kinds > 1")
    one = F.min(F.struct("id", "th", "start", "more", "ahead")).alias("one")
    kinds = scratch.write(open_.groupBy("fp", "h").agg(F.count("*").alias("n"), F.max("kinds").alias("kinds"), one), "kinds")
    ranges.append(hot_split_join(open_, kinds.filter("n > 1").select("h", F.col("fp").alias("fp2"), "n"), "h", "n").filter("fp = fp2").select("id", "th", "start", F.array(whole).alias("spans")))

    # the text of one segment of each kind
    spans = F.struct(F.col("one.start").alias("at"), (F.col("one.more") + length).alias("size"), "fp", "h", "n", "kinds", F.col("one.more").alias("more"), F.col("one.ahead").alias("ahead"))
    wanted = scratch.write(kinds.groupBy("one.id", "one.th").agg(F.collect_list(spans).alias("spans")), "wanted")
    texts = docs.filter(_may_be_in(wanted, "id", filter_bits)).join(wanted.hint("merge"), ["id", "th"]).dropDuplicates(["id", "th"])
    pieces = texts.withColumn("bytes", _cut("text", "spans")).select(F.explode(F.arrays_zip("spans", "bytes")).alias("x"))
    pieces = scratch.write(pieces.select(*[F.col(f"x.spans.{c}").alias(c) for c in ("fp", "h", "n", "kinds", "more", "ahead")], F.col("x.bytes").alias("bytes")), "pieces")

    fits = F.col("kinds") <= group_rows
    facts = pieces.agg(F.count(F.when(fits, 1)), F.count(F.when(~fits, 1))).first()
    slices = max(1, math.ceil(facts[0] / family_rows))
    marked = pieces.filter(fits).drop("kinds").repartition(slices, "fp").mapInArrow(_family_in(length, anchor), f"fp long, h long, spans {SPANS}")
    if facts[1]:
        marked = marked.unionByName(_by_windows(pieces.filter(~fits), length, scratch))
    single = kinds.filter("n = 1").select("fp", "h", "one").join(marked.filter(F.size("spans") > 0).hint("merge"), ["fp", "h"])
    ranges.append(single.select("one.id", "one.th", "one.start", "spans"))

    every = ranges[0].unionByName(ranges[1]).unionByName(ranges[2])
    placed = F.transform("spans", lambda x: F.struct((F.col("start") + x.lo).alias("lo"), (F.col("start") + x.hi).alias("hi")))
    out = every.select("id", "th", placed.alias("r")).groupBy("id", "th").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    out = scratch.write(out, "ranges")
    scratch.drop("found", "kinds", "wanted", "pieces", "windows", "shared-windows")
    return out


def remove_repeats(
    docs: DataFrame, length: int = 200, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text",
    filter_bits: int = 1 << 27, family_rows: int = FAMILY_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """All rows of docs, without the text, plus kept (the text's UTF-8 bytes without those removed), n_bytes, n_removed and n_spans.

    Removed is each byte that a string of `length` bytes covers which starts at two places or more of all texts, overlapping ones and those of one text
    included; n_spans counts the stretches of removed bytes. Strings are judged on the input, all copies go, and none reaches over the end of a text.
    kept may begin or end within a character, since strings are of bytes.

    Null texts are empty; texts shorter than `length` bytes keep all. A null id is an id like others. Rows that repeat an id are texts each, so equal ones
    of at least `length` bytes are removed. Columns with the names of the added ones are replaced. An empty table gives an empty table. A text of any
    length is hashed in chunks. Equality rests on two 64-bit hashes for copies of whole segments, on the bytes themselves for all else.
    """
    if not 8 <= anchor <= length // 2:
        raise ValueError("anchor must be from 8 to half of length")
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    kept = [c for c in docs.columns if c not in (text_col, "kept", "n_bytes", "n_removed", "n_spans")]
    rows = keyed(docs, id_col).withColumn("__t", text_bytes(text_col)).withColumn("__th", F.xxhash64("__t"))
    texts = rows.select(F.col("__id").alias("id"), F.col("__th").alias("th"), F.col("__t").alias("text"))
    ranges = _repeats(texts, length, anchor, scratch, filter_bits, family_rows, group_rows)
    ranges = ranges.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("ranges").alias("__ranges"))
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], "__id", "__th", "__t")
    keep = _keep_udf(length)
    out = rows.join(ranges.hint("merge"), ["__id", "__th"], "left").withColumn("__k", keep("__t", "__ranges"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "__k.kept", "__k.n_bytes", "__k.n_removed", "__k.n_spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH texts AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, md5(b[i + 1 : i + 200]) AS w FROM (SELECT doc_id, b, unnest(range(n - 199)) AS i FROM texts WHERE n >= 200)),
again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM windows SEMI JOIN again USING (w)),
marked AS (
  SELECT doc_id, i, CASE WHEN i > max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens
  FROM starts),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM spans
  UNION ALL SELECT doc_id, max(hi), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT g.doc_id, unhex(string_agg(hex(t.b[g.lo + 1 : coalesce(g.hi, t.n)]), '' ORDER BY g.lo)) AS b FROM gaps g JOIN texts t USING (doc_id)
  WHERE coalesce(g.hi, t.n) > g.lo GROUP BY g.doc_id),
told AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN t.b ELSE coalesce(k.b, ''::BLOB) END) AS kept_sha256
FROM texts t LEFT JOIN told USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

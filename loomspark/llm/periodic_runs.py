"""Periodic runs: stretches of words that repeat with a smallest period, found by probing a harmonic grid.

A run of period p holds p places in a row whose word equals the one p places on, so one of them is a multiple of p. It is
enough to compare the words at jp and (j+1)p, n ln n comparisons for n words over all periods; places that match are
extended, by small chunks of all of them together first and then by growing slices, and grid points inside a run that is
already known are passed over. Each row is worked on by itself, so nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import small_batches, text_bytes, trim

CHUNK = 8  # words compared at once on either side of a match before it is looked at alone
STEP = 8  # a band of periods ends at STEP times its first
MOST_CELLS = 1 << 20  # of the chunks of one comparison


def _probes(ids: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, place) of the grid points of periods low to high whose words match; by period or by j, whichever takes fewer comparisons."""
    n = len(ids)
    periods, places = [], []
    if high - low < n // low:
        for p in range(low, high + 1):
            at = np.flatnonzero(ids[0 : n - p : p] == ids[p::p])
            if len(at):
                periods.append(np.full(len(at), p))
                places.append(at * p)
    else:
        for j in range((n - 1) // low):
            last = min(high, (n - 1) // (j + 1))
            here = ids[j * low : j * last + 1 : j] if j else ids[0]
            at = np.flatnonzero(here == ids[(j + 1) * low : (j + 1) * last + 1 : j + 1]) + low
            if len(at):
                periods.append(at)
                places.append(at * j)
    if not periods:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(periods), np.concatenate(places)


def _near(padded: np.ndarray, n: int, p: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Whether the equal stretch around each match may be as long as its period: its ends within a chunk are looked up for all matches at once."""
    k, keep = np.arange(CHUNK), np.zeros(len(p), bool)
    for lo in range(0, len(p), MOST_CELLS // CHUNK):
        ps, at = p[lo : lo + MOST_CELLS // CHUNK, None], i[lo : lo + MOST_CELLS // CHUNK, None]
        right = at + k
        same_right = padded[np.minimum(right, n + 1)] == padded[np.minimum(right + ps, n)]
        left = at - 1 - k
        same_left = padded[np.maximum(left, -1)] == padded[np.clip(left + ps, 0, n)]
        r = np.where(same_right.all(1), CHUNK, same_right.argmin(1))
        b = np.where(same_left.all(1), CHUNK, same_left.argmin(1))
        keep[lo : lo + len(ps)] = (r == CHUNK) | (b == CHUNK) | (r + b >= ps[:, 0])
    return keep


def _equal_ahead(ids: np.ndarray, i: int, p: int) -> int:
    """How many places from i on hold the word that stands p places on."""
    n, width, at = len(ids) - p, 64, i
    while at < n:
        to = min(n, at + width)
        differ = ids[at:to] != ids[at + p : to + p]
        if differ.any():
            return at + int(differ.argmax()) - i
        at, width = to, min(2 * width, 1 << 16)
    return max(at, i) - i


def _equal_behind(ids: np.ndarray, i: int, p: int) -> int:
    """How many places before i hold the word that stands p places on."""
    width, at = 64, i
    while at > 0:
        low = max(0, at - width)
        differ = ids[low:at] != ids[low + p : at + p]
        if differ.any():
            return i - (low + len(differ) - int(differ[::-1].argmax()))
        at, width = low, min(2 * width, 1 << 16)
    return i


def find_runs(ids: np.ndarray, min_words: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(min_words, 2 * period) words, by start, then period.

    Two stretches whose periods are multiples of one another and that both reach over 2 periods are the same stretch if one lies in the other, so
    the first found, in rising order of periods, has the smallest period.
    """
    n = len(ids)
    padded = np.concatenate([ids, [-1, -2]])  # what stands outside differs from all words and from each other
    runs: dict[tuple[int, int], int] = {}
    low = 1
    while low <= n // 2:
        high = min(n // 2, STEP * low - 1)
        p, i = _probes(ids, low, high)
        if len(p) and runs:
            order = np.argsort(i, kind="stable")
            p, i = p[order], i[order]
            open_ = np.ones(len(p), bool)
            for (start, end), q in runs.items():
                if end - start > low:
                    a, b = np.searchsorted(i, (start, end))
                    open_[a:b] &= ~((p[a:b] % q == 0) & (i[a:b] + p[a:b] < end))
            p, i = p[open_], i[open_]
        if len(p):
            near = _near(padded, n, p, i)
            p, i = p[near], i[near]
            order = np.lexsort((i, p))
            p, i = p[order], i[order]
        at = 0
        while at < len(p):
            period, place = int(p[at]), int(i[at])
            start = place - _equal_behind(ids, place, period)
            stop = place + _equal_ahead(ids, place, period)
            if stop - start >= max(period, min_words - period):
                runs.setdefault((start, stop + period), period)
            last = int(np.searchsorted(p, period, "right"))
            at += int(np.searchsorted(i[at:last], max(stop, place + 1)))
        low = high + 1
    return sorted((start, end - start, q) for (start, end), q in runs.items())


def _runs_udf(min_words: int, rewrite: Callable[[list[bytes], int | None], list[bytes]] | None):
    @F.arrow_udf("struct<runs:array<struct<start:long,length:long,period:long>>,collapsed:string>")
    def runs_of(texts: pa.Array, row_ids: pa.Array) -> pa.Array:
        starts, lengths, periods, offsets, kept = [], [], [], [0], []
        for t, x in zip(texts, row_ids):
            words = t.as_py().split()
            if rewrite:
                words = rewrite(words, x.as_py())
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
            found = find_runs(ids, min_words)
            if found:
                edge = np.zeros(len(words) + 1, np.int32)
                for start, length, period in found:
                    edge[start + period] += 1
                    edge[start + length] -= 1
                words = [w for w, gone in zip(words, edge.cumsum().tolist()) if not gone]
                for out, column in zip((starts, lengths, periods), zip(*found)):
                    out += column
            offsets.append(len(starts))
            kept.append(b" ".join(words))
        runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (starts, lengths, periods)], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)
        collapsed = pa.array(kept, pa.binary()).cast(pa.string())
        del kept
        trim()
        return pa.StructArray.from_arrays([runs, collapsed], ["runs", "collapsed"])

    return runs_of


def periodic_runs(docs: DataFrame, min_words: int = 12, rewrite: Callable[[list[bytes], int | None], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs plus runs, an array of (start, length, period) by start, then period, and collapsed: the text's words joined by one
    space, without those that a run holds after its first period.

    Words are what ASCII white space parts; they are numbered from 0 and equal only if all their bytes are. A run has at least min_words words and two
    whole periods, its period is the smallest that it has, and no word beside it continues it. rewrite, if given, gets a text's words and its id and
    returns the words to look at.

    Null, empty and blank texts have no runs and an empty collapsed text. A null id is passed to rewrite as None. Rows that repeat an id or a text are
    worked on each. Columns named runs or collapsed are replaced. An empty table gives an empty table. A text may be of any length: what is held
    at once is a few numbers for each of its words.
    """
    small_batches(docs.sparkSession)
    found = docs.withColumn("__r", _runs_udf(min_words, rewrite)(text_bytes(text_col), F.col(id_col)))
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed")]
    return found.select(*names, "__r.runs", "__r.collapsed")


def planted(words: list[bytes], row_id: int | None) -> list[bytes]:
    """The query's input: in a tenth of the documents, by crc32 of the id, all words from a place on repeat the ones that stand there."""
    if row_id is None or not words:
        return words
    h = zlib.crc32(str(row_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs, rewrite=planted)
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS s, -r.period AS p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.p")
    return out.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# DuckDB has no crc32: the table of its 256 steps, and a fold over the bytes
CRC_TABLE = """(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce([i::BIGINT] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""

# A run holds at least six places in a row that equal those a period on: equal stretches of six words at both, joined within a document, in islands.
SQL = f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM documents, crc),
placed AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
docs AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE w[1:a] || list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1]) END AS w
  FROM placed),
grams AS MATERIALIZED (SELECT doc_id, i, hash(w[i + 1 : i + 6]) AS k, w[i + 1 : i + 6] AS six FROM docs, unnest(range(n - 5)) u(i)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i AND x.six = y.six),
islands AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, p, min(i) AS start, count(*) + 5 + p AS length FROM islands GROUP BY doc_id, p, island),
runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(p) AS period FROM stretches WHERE length >= greatest(12, 2 * p) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT d.doc_id, string_agg(d.w[d.i + 1], ' ' ORDER BY d.i) AS text
  FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM docs) d ANTI JOIN gone g ON d.doc_id = g.doc_id AND d.i = g.i GROUP BY d.doc_id),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         arg_max(struct_pack(start := start, length := length, period := period), (length, -start, -period)) AS best
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN told USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

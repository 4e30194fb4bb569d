"""Target-distribution importance resampling: draw documents whose words are distributed like a target's.

Words and word runs are hashed to buckets. A bucket's gain is the logarithm of its share in the target over its share in
the documents; a document's weight is the mean gain of its features, looked up in one array for a whole batch. With Gumbel
noise on top, the highest scores are a draw without replacement. The draw is external: each task sorts its eligible rows
into runs, written to the shared folder; regular samples of the runs cut them into ranges; each range's pieces are merged
by a tournament tree in a task of its own, which knows the rank it begins at and stops at the exact number drawn.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, keyed, text_bytes, trim
from loomspark.llm.periodic_runs import CRC_TABLE

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MEMO = 200_000  # words whose bucket a worker remembers
RUN_ROWS, PIECE_ROWS, RANGE_ROWS = 1 << 20, 1 << 13, 1 << 17
MOST_RANGES, SAMPLES = 2000, 64  # the driver sees SAMPLES keys a range and run at most


def _buckets_udf(most_words: int, buckets: int):
    memo: dict[bytes, int] = {}

    @F.arrow_udf("struct<n_words:long,buckets:array<int>>")
    def features(texts: pa.Array) -> pa.Array:
        counts, flat, offsets = [], [], [0]
        for t in texts:
            words = WORD.findall(t.as_py().lower())
            for n in range(1, most_words + 1):
                for x in words if n == 1 else map(b" ".join, zip(*(words[k:] for k in range(n)))):
                    b = memo.get(x)
                    if b is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        b = memo[x] = zlib.crc32(x) % buckets
                    flat.append(b)
            counts.append(len(words))
            offsets.append(len(flat))
        found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, np.int32)))
        del flat
        trim()
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), found], ["n_words", "buckets"])

    return features


def bucket_counts(bags: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket: every task counts into one array, and only its non-zero places are added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in bags.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's smoothed share in the target over that in the source, floored."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((y + 1.0) * s / ((x + 1.0) * t))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def _weights_udf(gain: np.ndarray):
    @F.arrow_udf("long")
    def weights(bags: pa.Array) -> pa.Array:
        n = pc.list_value_length(bags).to_numpy()
        sums = np.concatenate([[0], np.cumsum(gain[bags.flatten().to_numpy()])])
        ends = np.cumsum(n)
        return pa.array((sums[ends] - sums[ends - n]) // np.maximum(n, 1))

    return weights


def noise(seed: int, id_col: str) -> Column:
    """Gumbel noise in thousandths, by a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _order(score: np.ndarray, ids: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Highest score first, ties to the smaller id, then as the rows stand."""
    return np.lexsort((tag, ids, -score))


def _runs_of(run_rows: int, step: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def run() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held)]
            order = _order(*columns)
            columns = [c[order] for c in columns]
            n, number = len(order), (part << 32) + made
            first = zlib.crc32(str(number).encode()) % step  # so that runs shorter than a step are sampled too
            for lo in range(0, n, PIECE_ROWS):
                picked = pa.array(np.arange(lo, min(n, lo + PIECE_ROWS)) % step == first)
                cut = [pa.array(c[lo : lo + PIECE_ROWS]) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(picked), number)), *cut, picked], ["run", "score", "id", "tag", "picked"])

        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            rows += b.num_rows
            if rows >= run_rows:
                yield from run()
                made, held, rows = made + 1, [], 0
        if rows:
            yield from run()

    return runs


def _pieces_of(splitters: list[tuple[int, int, int]]):
    """Cuts sorted rows at the splitters, which begin a range each."""
    marks = [np.array(c, np.int64) for c in zip(*splitters)] if splitters else [np.empty(0, np.int64)] * 3

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            run, *key = (c.to_numpy() for c in b.columns)
            # a row's range: the splitters at or before it, counted in one common order
            both = [np.concatenate([m, c]) for m, c in zip(marks, key)]
            order = _order(*both)
            is_mark = order < len(marks[0])
            ranges = np.empty(len(run), np.int64)
            ranges[order[~is_mark] - len(marks[0])] = np.cumsum(is_mark)[~is_mark]
            cuts = np.flatnonzero(np.diff(run) | np.diff(ranges)) + 1
            offsets = np.concatenate([[0], cuts, [len(run)]]).astype(np.int32) if len(run) else np.zeros(1, np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(c)) for c in key]
            sizes = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ranges[offsets[:-1]]), pa.array(sizes), *lists], ["range", "size", "score", "id", "tag"])

    return pieces


def tournament(pieces: list[list[tuple]], most: int) -> Iterator[tuple]:
    """The first `most` entries of all the sorted pieces in order. A tree holds at each node the winner of the two below; a winner's next entry replays its path only."""
    if not pieces:
        return
    k = len(pieces)
    leaves = 1 << (k - 1).bit_length()
    end = (math.inf,)  # after all entries
    heads = [p[0] if p else end for p in pieces] + [end] * (leaves - k)
    place = [0] * k
    tree = [0] * leaves + list(range(leaves))
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if heads[a] <= heads[b] else b
    for _ in range(most):
        w = tree[1] if leaves > 1 else 0
        if heads[w] is end:
            return
        yield heads[w]
        place[w] += 1
        heads[w] = pieces[w][place[w]] if place[w] < len(pieces[w]) else end
        i = (leaves + w) >> 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if heads[a] <= heads[b] else b
            i >>= 1


def _merge_of(begins: dict[int, int], drawn: int):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        pieces = []
        for score, ids, tag in zip(*(table.column(n) for n in ("score", "id", "tag"))):
            pieces.append(list(zip((-score.values.to_numpy()).tolist(), ids.values.to_numpy().tolist(), tag.values.to_numpy().tolist())))
        first = begins[key[0].as_py()]
        tags = np.fromiter((t for _, _, t in tournament(pieces, drawn - first)), np.int64)
        return pa.table([pa.array(tags), pa.array(np.arange(first + 1, first + 1 + len(tags)))], ["tag", "rank"])

    return merge


def draw(scored: DataFrame, drawn: int, scratch: Scratch, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """tag and rank (from 1) of the `drawn` highest of scored (score, id, tag), ties to the smaller id.

    A task holds one run or one range: run_rows or about range_rows keys, of three longs each. Beyond MOST_RANGES * range_rows rows the ranges grow.
    """
    rows = scored.count()
    ranges = max(1, min(MOST_RANGES, math.ceil(rows / range_rows)))
    step = max(1, math.ceil(rows / ranges / SAMPLES))
    runs = scratch.write(scored.select("score", "id", "tag").mapInArrow(_runs_of(run_rows, step), "run long, score long, id long, tag long, picked boolean"), "runs")
    splitters = []
    if ranges > 1:
        samples = sorted((-r.score, r.id, r.tag) for r in runs.filter("picked").select("score", "id", "tag").collect())  # about SAMPLES a range
        splitters = [(-s, i, t) for s, i, t in samples[SAMPLES - 1 :: SAMPLES]]
    pieces = runs.select("run", "score", "id", "tag").mapInArrow(_pieces_of(splitters), "range long, size long, score array<long>, id array<long>, tag array<long>")
    pieces = scratch.write(pieces, "pieces")
    begins, before = {}, 0
    for r in sorted(pieces.groupBy("range").agg(F.sum("size").alias("n")).collect()):  # a row for each of at most MOST_RANGES ranges
        begins[r.range] = before
        before += r.n
    needed = [r for r, first in begins.items() if first < drawn]
    chosen = pieces.filter(F.col("range") <= (max(needed) if needed else -1))
    return chosen.groupBy("range").applyInArrow(_merge_of(begins, drawn), "tag long, rank long")


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, most_words: int = 1, buckets: int = 10_000, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """All rows of docs, without the text, plus n_features, weight, score and rank (1, 2, 3... of the rows drawn, null for others).

    Features are the runs of 1 to most_words words of the text with A-Z lower-cased, repeats counted. Of the N rows with at least min_words words,
    the floor(percent * N / 100) with the highest scores are drawn, ties to the smaller id. The same seed gives the same draw.

    Null, empty and wordless texts have no features and weight 0, and are never drawn where min_words is over 0. A null id counts as the smallest, and as
    the empty text in the noise. Rows that repeat an id have the same noise and are drawn each; the order among equal ones is that of the rows. An empty
    target has uniform shares. Columns with the names of the added ones are replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    features = _buckets_udf(most_words, buckets)
    kept = [c for c in docs.columns if c not in (text_col, "n_features", "weight", "score", "rank")]
    bags = keyed(docs, id_col).select(*[F.col(f"`{c}`") for c in kept], "__id", features(text_bytes(text_col)).alias("__f"))
    bags = bags.select(*[F.col(f"`{c}`") for c in kept], "__id", F.monotonically_increasing_id().alias("__tag"), F.col("__f.n_words").alias("__words"), F.col("__f.buckets").alias("buckets"))
    bags = scratch.write(bags, "bags")
    wanted = target.select(features(text_bytes(target_text_col)).alias("f")).select("f.buckets")
    weights = _weights_udf(gains(bucket_counts(bags, buckets), bucket_counts(wanted, buckets)))
    scored = bags.withColumn("n_features", F.size("buckets").cast("long")).withColumn("weight", weights("buckets")).drop("buckets")
    scored = scratch.write(scored.withColumn("score", F.col("weight") + noise(seed, id_col)), "scored")
    scratch.drop("bags")
    eligible = scored.filter(F.col("__words") >= min_words).select("score", F.col("__id").alias("id"), F.col("__tag").alias("tag"))
    ranks = draw(eligible, percent * eligible.count() // 100, scratch, run_rows, range_rows).withColumnRenamed("tag", "__tag")
    return scored.join(ranks, "__tag", "left").select(*[F.col(f"`{c}`") for c in kept], "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return importance_resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


SQL = f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
texts AS (SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark),
words AS MATERIALIZED (
  SELECT doc_id, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
  FROM texts),
hexed AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words)),
bytes AS (
  SELECT w, list_transform(range(len(x) // 2), lambda i: 16::BIGINT * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS b
  FROM hexed),
buckets AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
counts AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM words JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gained AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, totals),
weighed AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN buckets USING (w) JOIN gained USING (bucket) WHERE side = 0 GROUP BY doc_id),
hashed AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256('2024:' || doc_id)[1:8], ''), lambda d: instr('0123456789abcdef', d)::BIGINT - 1)),
                     lambda a, d: 16 * a + d) AS h
  FROM documents LEFT JOIN weighed USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM hashed),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

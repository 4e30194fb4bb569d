"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled (by a hash) and laid end to end on a tape of words, which repeats up to
`most_times`; the tape is cut into blocks of equal words. Slot t of the mix has the golden-ratio point t * GOLD mod PERIOD;
cumulative weights map it to a source, and the source's k-th slot takes its k-th block. A source's words in the mix are
those of the blocks that its slots deal to it, so they come within the schedule's discrepancy (a few blocks) of its target.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomspark.llm.common import Scratch, hot_split_join, text_bytes

PERIOD = 1 << 31
GOLD = 1327217885  # PERIOD divided by the golden ratio; odd, so a period meets every point once
LEAST_SLOTS, MOST_SLOTS = 256, 1 << 30
LEVEL = 3  # hex digits of the shuffle key for each level of the running sums: at most 4096 rows a window


@F.arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Number of runs of bytes other than ASCII white space."""
    return pa.array([len(t.as_py().split()) for t in texts], pa.int64())


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most_times: int) -> DataFrame:
    """sizes (src, null_src, source, source_size) plus cap (the most that it can give) and target. Water-filling in closed form: by
    rising ratio of limit to weight, a source is at its limit while its limit is at most its share of what the earlier ones leave."""
    place = Window.orderBy("null_src", "source")
    w = F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    out = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most_times)
    total = F.sum("source_size").over(Window.partitionBy())
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "null_src", "source")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("rem", total - before).withColumn("wrem", left)
    out = out.withColumn("capped", F.col("cap") * F.col("wrem") <= F.col("rem") * F.col("w"))
    first = F.min_by(F.struct("rem", "wrem"), F.when(~F.col("capped"), F.col("cap") / F.col("w"))).over(Window.partitionBy())
    out = out.withColumn("level", first)
    share = (F.col("w") * F.col("level.rem")).cast("double") / F.col("level.wrem").cast("double")
    out = out.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share))
    return out.drop("w", "rem", "wrem", "capped", "level")


def source_shares(targets: DataFrame, block: int) -> DataFrame:
    """targets plus words (of one of the source's blocks), slots (of the whole mix), and lo and hi: the points [lo, hi) are the source's.

    A block has `block` words, more where the mix would need over MOST_SLOTS slots, and fewer in sources of less than LEAST_SLOTS blocks.
    """
    everything = Window.partitionBy()
    whole = F.greatest(F.lit(block).cast("long"), F.ceil(F.sum("source_size").over(everything) / MOST_SLOTS))
    out = targets.withColumn("words", F.greatest(F.lit(1).cast("long"), F.least(whole, F.floor(F.col("target") / LEAST_SLOTS))))
    blocks = F.when(F.col("target") > 0, F.greatest(F.lit(1).cast("long"), F.floor(F.col("target") / F.col("words") + 0.5))).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("blocks", blocks).withColumn("slots", F.sum("blocks").over(everything))
    out = out.withColumn("end", F.sum("blocks").over(Window.orderBy("null_src", "source").rowsBetween(Window.unboundedPreceding, 0)))
    point = lambda at: F.when(F.col("slots") > 0, F.expr(f"(({at}) * {PERIOD} + slots - 1) div slots")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("lo", point("end - blocks")).withColumn("hi", point("end")).drop("blocks", "end")


def _running(rows: DataFrame, levels: int) -> DataFrame:
    """rows (src, m, uid, size) plus at: the sizes before each in its source, by m. A window holds 4096 sums at most,
    or the rows of one hash prefix."""
    prefix = [F.substring("m", 1, LEVEL * k) for k in range(levels + 1)]
    rows = rows.withColumn("p", prefix[levels])
    sums = rows.groupBy("src", "p").agg(F.sum("size").alias("s"))
    offset = None
    for k in range(1, levels + 1):
        cut = sums.groupBy("src", F.substring("p", 1, LEVEL * k).alias("q")).agg(F.sum("s").alias("s"))
        cut = cut.withColumn("up", F.substring("q", 1, LEVEL * (k - 1)))
        own = F.sum("s").over(Window.partitionBy("src", "up").orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
        cut = cut.select("src", "q", "up", F.coalesce(own, F.lit(0)).alias("own"))
        if offset is not None:
            cut = cut.join(offset.withColumnRenamed("q", "up").withColumnRenamed("base", "b"), ["src", "up"]).withColumn("own", F.col("own") + F.col("b"))
        offset = cut.select("src", "q", F.col("own").alias("base"))
    inside = F.sum("size").over(Window.partitionBy("src", "p").orderBy("m", "uid").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    joined = rows.join(offset.withColumnRenamed("q", "p"), ["src", "p"])
    return joined.withColumn("at", F.col("base") + F.col("inside")).drop("p", "inside", "base")


def schedule(spark: SparkSession, shares: DataFrame, slots: int, chunk: int = 1 << 16) -> DataFrame:
    """(src, rank, slot) of the first `slots` golden-ratio points; shares: src and the points [lo, hi) that are its own.

    Points meet sources by buckets of the period, twice as many as there are sources. Ranks come from counts by chunk and source, then within one.
    """
    width = PERIOD >> max(12, min(24, math.ceil(math.log2(2 * max(1, shares.count())))))
    cell = lambda at: F.expr(f"{at} div {width}")
    spans = shares.filter("hi > lo").select("src", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("(hi - 1)"))).alias("bucket"))
    t = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") % PERIOD * GOLD % PERIOD).alias("x"))
    hit = t.withColumn("bucket", cell("x")).join(spans, "bucket").filter((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
    hit = hit.select("src", "slot", F.expr(f"slot div {chunk}").alias("chunk"))
    counts = hit.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("src", "chunk", F.coalesce(base, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("inside", inside).join(counts, ["src", "chunk"])
    return ranked.select("src", (F.col("base") + F.col("inside")).alias("rank"), "slot")


def mix_spans(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = 3, block: int = 1024, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, int]:
    """From a written table (uid, source, size, m) two frames, and the number of slots.

    per_row: uid, size, source_size, target. spans: uid, size, times (0 is the first), lo, hi (words of the document), slot
    (place in the mix). A row without words, or beyond its source's last block, has no span.
    """
    spark = sized.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    rows = sized.select("uid", "size", "m", src.alias("src"), "source")
    sizes = rows.groupBy("src", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).withColumn("null_src", F.col("source").isNull())
    shares = scratch.write(source_shares(source_targets(sizes, weights, most_times), block).drop("source", "null_src"), "shares")
    slots, most_rows = shares.agg(F.max("slots"), F.max("n")).first()
    slots, levels = slots or 0, max(1, math.ceil(math.log(max((most_rows or 0) / 2000, 1), 16**LEVEL)))
    order = scratch.write(schedule(spark, shares.select("src", "lo", "hi"), slots), "order")
    dealt = order.groupBy("src").agg(F.count("*").alias("dealt"))
    limit = F.least(F.col("cap"), F.coalesce("dealt", F.lit(0)) * F.col("words"))
    shares = scratch.write(shares.join(dealt, "src", "left").select("src", "source_size", "target", "words", limit.alias("limit"), "n"), "dealt")
    scratch.drop("shares")
    placed = scratch.write(_running(rows.select("uid", "size", "m", "src"), levels), "placed")
    placed = hot_split_join(placed, shares, "src", "n")
    times = F.explode(F.sequence(F.lit(0), F.lit(most_times - 1))).alias("times")
    laid = placed.filter("size > 0").select("uid", "src", "size", "at", "source_size", "limit", "words", times)
    laid = laid.withColumn("begin", F.col("times") * F.col("source_size") + F.col("at")).filter("begin < limit").withColumn("end", F.expr("least(begin + size, limit)"))
    cut = laid.withColumn("rank", F.explode(F.expr("sequence(begin div words, (end - 1) div words)")))
    lo = F.greatest(F.col("begin"), F.col("rank") * F.col("words")) - F.col("begin")
    hi = F.least(F.col("end"), (F.col("rank") + 1) * F.col("words")) - F.col("begin")
    cut = cut.select("uid", "size", "src", "times", "rank", lo.alias("lo"), hi.alias("hi"))
    spans = cut.join(order, ["src", "rank"]).select("uid", "size", "times", "lo", "hi", "slot")
    return placed.select("uid", "size", "source_size", "target"), spans, slots


def shuffle_key(id_col: str, text_col: str):
    """md5 over the id and the text's md5: the same on every run and engine."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_bytes(text_col))).cast("binary"))


def _sized(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str, keep: list[Column]) -> DataFrame:
    return scratch.write(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(source_col).alias("source"), word_count(text_bytes(text_col)).alias("size"), shuffle_key(id_col, text_col).alias("m"), *keep), "sized")


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = 3, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: id, size, source_size, target, taken (words that the mix takes of it, repeats counted).

    Null or empty text: size 0, nothing taken. Null source: a source of its own, the last. Repeated ids and rows count
    each for themselves. Other columns stay out. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "mix-counts")
    sized = _sized(docs, scratch, id_col, text_col, source_col, [F.col(id_col).alias("__doc")])
    per_row, spans, _ = mix_spans(sized, weights, most_times, block)
    taken = spans.groupBy("uid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    out = sized.select("uid", "__doc").join(per_row, "uid").join(taken, "uid", "left")
    return out.select(F.col("__doc").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _words_of(text: str, lo: str, hi: str, size: str) -> Column:
    """Words lo to hi of a text, with the white space before each, and after the last word that before the text's end."""
    word = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    some = F.array_join(F.slice(word, F.col(lo).cast("int") + 1, (F.col(hi) - F.col(lo)).cast("int")), "")
    return F.when(F.col(hi) < F.col(size), some).otherwise(F.concat(some, F.regexp_extract(text, r"[\x20\x09-\x0D]*\z", 0)))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = 3, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, in its order: docs' columns plus slot, one row for each time that a document is taken, its text cut to the words taken.

    slot is the first of the schedule's slots that the row fills; partitions follow each other by slot, and rows in them too. The same cases as in
    mix_counts; rows of which nothing is taken are not in the mix. n_chars, where docs has it, is that of the new text. A column named slot is replaced.
    """
    scratch = Scratch(docs.sparkSession, "mix-documents")
    kept = [c for c in docs.columns if c != "slot"]
    named = docs.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias("__uid"), word_count(text_bytes(text_col)).alias("__size"), shuffle_key(id_col, text_col).alias("__m"))
    written = scratch.write(named, "documents")
    sized = written.select(F.col("__uid").alias("uid"), F.col(source_col).alias("source"), F.col("__size").alias("size"), F.col("__m").alias("m"))
    steps = Scratch(docs.sparkSession, "mixing")
    _, spans, slots = mix_spans(sized, weights, most_times, block, steps)
    once = spans.groupBy(F.col("uid").alias("__uid"), F.col("times").alias("__times")).agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi"), F.min("slot").alias("slot"))
    once = scratch.write(once, "once")
    steps.drop()
    out = written.drop("__m").join(once.hint("merge"), "__uid")
    text = F.when((F.col("__lo") == 0) & (F.col("__hi") >= F.col("__size")), F.col(text_col)).otherwise(_words_of(text_col, "__lo", "__hi", "__size"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.withColumn("__text", text).drop(text_col).repartitionById(parts, F.expr(f"cast(slot * {parts} div {max(1, slots)} as int)")).sortWithinPartitions("slot", "__uid", "__times")
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.length("__text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in kept], "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_counts(docs)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))) AS m
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM sizes),
left_over AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rem,
         (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS wrem
  FROM weighed),
limited AS (SELECT *, cap * wrem <= rem * w AS capped FROM left_over),
level AS (SELECT rem AS r, wrem AS wr FROM limited WHERE NOT capped ORDER BY cap / w LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (w * r)::DOUBLE / wr::DOUBLE END AS target, cap
  FROM limited LEFT JOIN level ON true),
blocked AS (
  SELECT *, greatest(1, least(greatest(1024, ceil(sum(source_size) OVER () / 1073741824)::BIGINT), floor(target / 256)::BIGINT))::BIGINT AS words FROM targets),
counted AS (SELECT *, CASE WHEN target > 0 THEN greatest(1, floor(target / words + 0.5)::BIGINT) ELSE 0 END AS blocks FROM blocked),
ended AS (
  SELECT *, sum(blocks) OVER ()::HUGEINT AS slots, sum(blocks) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::HUGEINT AS last
  FROM counted),
shares AS (
  SELECT *, ((last - blocks) * 2147483648 + slots - 1) // greatest(slots, 1) AS lo, (last * 2147483648 + slots - 1) // greatest(slots, 1) AS hi FROM ended),
points AS (SELECT (slot % 2147483648) * 1327217885 % 2147483648 AS x FROM range((SELECT coalesce(max(slots), 0)::BIGINT FROM shares)) AS r(slot)),
dealt AS (SELECT s.source, count(*) AS dealt FROM points p JOIN shares s ON p.x >= s.lo AND p.x < s.hi GROUP BY s.source),
wanted AS (SELECT s.*, least(cap, coalesce(d.dealt, 0) * words)::BIGINT AS want FROM shares s LEFT JOIN dealt d ON s.source IS NOT DISTINCT FROM d.source),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY m, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_word FROM sized)
SELECT p.doc_id, p.size, t.source_size, t.target,
       (least(at_word + size, want) - least(at_word, want)
        + least(source_size + at_word + size, want) - least(source_size + at_word, want)
        + least(2 * source_size + at_word + size, want) - least(2 * source_size + at_word, want))::BIGINT AS taken
FROM placed p JOIN wanted t ON p.source IS NOT DISTINCT FROM t.source
"""

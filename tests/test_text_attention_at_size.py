"""Attention between words and maps of tokens without shuffled pairs: the same as by joins."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from loomspark.operators import align as L
from loomspark.operators import text_attention as TA
from loomspark.plans import catalogue


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_stream_through_small_batches(spark):
    """Bands reach over the borders of batches, never over those of texts, and cells need no join; tokens in any order are put in order."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(rng.choice("abc") for _ in range(n))) for k, n in enumerate((3, 50, 1, 0, 41))], "doc_id long, text string")
    tokens = TA.tokens_of(docs)
    plain = lambda df: sorted((r.doc_id, r.layer, r["head"], r.i, r.j, round(r.w, 12)) for r in df.collect())
    want = plain(TA.banded_attention(tokens, (4, 16), (0, 2), ordered=True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = TA.banded_attention(tokens.coalesce(1), (4, 16), (0, 2), ordered=True)
        assert plain(got) == plain(TA.banded_attention(tokens.orderBy(F.rand(1)), (4, 16), (0, 2))) == want
        assert "Join" not in _plan(got) and "Window" not in _plan(got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dual_attention_pools_where_cells_lie(spark):
    """Cells know their pieces: as pooled by joins with the tokens, and one shuffle of sums instead."""
    docs = spark.createDataFrame([(1, "a b a\n\nb a c\n\n\n\na  b"), (2, " "), (3, None), (4, "x x")], "doc_id long, text string")
    one = TA.segment_with_dual_attention(docs)[1]
    other = TA.segment_with_dual_attention(docs, attn=TA.banded_attention(TA.tokens_of(docs)))[1]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.count() > 3
    assert _plan(one).count("Join") < _plan(other).count("Join")


def test_hits_of_a_row(spark):
    """As interval_map: empty, reversed, nested and far ranges, and texts without tokens or segments."""
    rng = random.Random(5)
    tokens, segs = [], []
    for doc in range(6):
        at = [rng.randrange(3000) for _ in range(40 if doc else 0)]
        tokens += [(doc, k, b, b + rng.choice([0, 1, 5, 700])) for k, b in enumerate(at)]
        segs += [(doc, k, b, b + n) for k, (b, n) in enumerate((rng.randrange(3000), rng.choice([0, 3, 60, 2500])) for _ in range(9 if doc != 3 else 0))]
    t = spark.createDataFrame(tokens, "doc_id long, tok_idx long, begin long, end long")
    s = spark.createDataFrame(segs, "doc_id long, seg_idx long, begin long, end long")
    want = sorted((r.doc_id, r.tok_idx, r.seg_idx, r.n_segs) for r in L.interval_map(t, s).collect())
    gathered = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "begin", "end"))).alias("t"))
    rows = gathered.join(s.groupBy("doc_id").agg(F.collect_list(F.struct("seg_idx", "begin", "end")).alias("s")), "doc_id", "left")
    got = rows.select("doc_id", F.posexplode(L.interval_hits(F.col("t"), F.col("s"), 64)).alias("k", "h")).select("doc_id", "k", "h.*")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 200


def test_interval_map_shuffles_nothing(spark, sf_dir):
    plan = catalogue.queries()["tok_interval_map"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_window_hits_by_slices(spark, sf_dir):
    """As interval_hits, with texts cut by slices, without words and null; no result of a batch is held as a whole."""
    rng = random.Random(9)
    texts = [(k, [rng.choice(["a", "", "wörd", "x" * 500, "yz"]) + "q" for _ in range(n)]) for k, n in enumerate([0, 3, 700, 1, 64, 40])] + [(9, None)]
    rows = spark.createDataFrame(texts, "doc_id long, w array<string>").coalesce(1)
    old = rows.select("doc_id", L.joined_places(F.col("w")).alias("t")).filter(F.size("t") > 0)
    segs = F.transform(F.sequence(F.lit(0).cast("long"), F.element_at("t", -1)["end"] - 1, F.lit(200).cast("long")), lambda b: F.struct(F.floor(b / 200).alias("seg_idx"), b.alias("begin"), (b + 230).alias("end")))
    want = sorted(map(tuple, old.select("doc_id", F.posexplode(L.interval_hits(F.col("t"), segs)).alias("k", "h")).select("doc_id", "k", "h.*").collect()))
    for most in (1, 64, 1 << 17):
        assert sorted(map(tuple, L.window_hits(rows, "doc_id", F.col("w"), 200, 230, most).collect())) == want and len(want) == 808
    batch = pa.record_batch([pa.array([1, 2]), pa.array([[1] * 1000, [2] * 5])], ["doc_id", "sizes"])
    assert [b.num_rows for b in L._window_hits(200, 230, 300)(iter([batch]))] == [300, 300, 300, 105]
    plan = catalogue.queries()["tok_interval_map"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_joined_places(spark):
    rows = spark.createDataFrame([(["ä", "", "xyz"],), (None,), ([],), (["b"],)], "w array<string>")
    got = [r[0] and [tuple(x) for x in r[0]] for r in rows.select(L.joined_places(F.col("w"))).collect()]
    assert got == [[("ä", 0, 1), ("", 2, 2), ("xyz", 3, 6)], [], [], [("b", 0, 1)]]

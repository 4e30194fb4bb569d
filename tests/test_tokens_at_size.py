"""Positions and levels of tokens: the same results without work that grows faster than the text."""

import time

from pyspark.sql import functions as F

from loomspark.operators import align as L


def test_positions_of_a_long_text(spark):
    """Linear in the text: 40,000 tokens took minutes when each step copied those before it."""
    row = spark.range(1).select(F.array_repeat(F.lit("wörd"), 40_000).alias("tokens")).withColumn("text", F.array_join("tokens", " "))
    began = time.time()
    got = row.select(F.explode(L.token_positions(F.col("text"), F.col("tokens"))).alias("t")).agg(F.count("*"), F.max("t.end"), F.sum(F.col("t.end") - F.col("t.begin"))).first()
    assert tuple(got) == (40_000, 40_000 * 5 - 1, 160_000) and time.time() - began < 30


def test_positions_of_odd_tokens(spark):
    rows = spark.createDataFrame([("a b ## b", ["[CLS]", "Ġa", None, "nowhere", "##b", "##", "▁b", ""]), (None, ["x"]), ("x", None)], "text string, tokens array<string>")
    got = [r[0] if r[0] is None else [tuple(t) for t in r[0]] for r in rows.select(L.token_positions(F.col("text"), F.col("tokens"))).collect()]
    first = [("[CLS]", 0, 0), ("Ġa", 0, 1), (None, 1, 1), ("nowhere", 1, 1), ("##b", 2, 3), ("##", 4, 6), ("▁b", 7, 8), ("", 0, 0)]
    assert got == [first, [("x", 0, 0)], None]


def test_uniform_levels(spark):
    """As the levels gathered token by token, by one sort and without such a gathering."""
    tokens = spark.range(23).select((F.col("id") % 2).alias("doc_id"), F.floor(F.col("id") / 2).alias("tok_idx"))
    each = L.uniform_map(tokens, 4).withColumn("level", F.lit(0)).unionByName(L.uniform_map(tokens, 8).withColumn("level", F.lit(1)))
    got = L.uniform_levels(tokens, [4, 8])
    plain = lambda df: sorted((r.doc_id, r.tok_idx, sorted(r.levels.items())) for r in df.collect())
    assert plain(got) == plain(L.multi_level(each))
    plan = L.uniform_levels(tokens, [4, 8])._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1

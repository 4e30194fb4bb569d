"""Queries whose rows carried more through shuffles than their results need."""

from pyspark.sql import functions as F

from loomspark.operators import concepts as C
from loomspark.operators import graph as G
from loomspark.plans import catalogue


def test_dual_edges_of_one_table_need_no_join(spark, sf_dir):
    rows = [(i, j, 0.1 * k) for k, (i, j) in enumerate((i, j) for i in range(4) for j in range(4))]
    cells = spark.createDataFrame(rows, "i long, j long, w double")
    tok = cells.filter("(i + j) % 2 = 0").withColumn("w", F.col("w") / 2)
    kinds = cells.filter("i % 3 = 0").selectExpr("i", "j", "CAST(j AS INT) AS edge_type")
    joined = G.dual_level_edges(cells, tok, 0.33, kinds)
    own = G.dual_level_edges(cells, F.expr("CASE WHEN (i + j) % 2 = 0 THEN w / 2 END"), 0.33, F.expr("CASE WHEN i % 3 = 0 THEN CAST(j AS INT) END"))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, joined.collect())) and own.count() > 5
    assert "Join" not in catalogue.queries()["graph_dual_edges"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_lists_read_written_edges(spark, sf_dir):
    """The pairs are found once, not again for each direction and count."""
    plan = catalogue.queries()["graph_adjacency_lists"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan


def test_evolution_of_repeated_turns(spark):
    """A turn that is there twice is one mention, and its words meet those of both rows, as in the SQL; words don't travel with threads."""
    turns = spark.createDataFrame(
        [(1, 0, "planet orbits"), (1, 1, "planet"), (1, 1, "planet moonlight"), (1, 9, "planet again whatever"), (2, None, "planet"), (2, 3, None), (None, 1, "planet")], "conv_id long, turn long, text string"
    )
    got = C.evolution(turns)
    want = C.evolution(turns, mentions=C.mentions_of(turns))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    planet = sorted((r.thread, r.first, r.last, r.mentions, r.changed) for r in got.filter("concept = 'planet'").collect())
    assert planet == [(0, 0, 1, 2, False), (0, 0, 1, 2, False), (1, 9, 9, 1, False)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "concept#" in x and "w_first#" in x]

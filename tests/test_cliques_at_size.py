"""Triangles, 4-cliques and clustering by cells of parts: those of all edges at once, without rows for wedges."""

from itertools import combinations

import numpy as np
import pytest

from loomspark.operators import graph as G


def _graph(n=40, seed=2):
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (260, 2))} | {(0, i) for i in range(n)}
    return sorted((a * 7 - 50, b * 7 - 50) for a, b in pairs)  # loops, edges both ways and negative ids too


@pytest.mark.parametrize("most_edges", [1 << 21, 60])
def test_cliques_by_cells(spark, most_edges):
    pairs = _graph()
    e = spark.createDataFrame(pairs + pairs[:50], "src long, dst long").repartition(3)
    have = {frozenset(p) for p in pairs}
    for size in (3, 4):
        want = [c for c in combinations(sorted({x for p in pairs for x in p}), size) if all(frozenset(x) in have for x in combinations(c, 2))]
        got = G._by_cells(e, size, most_edges=most_edges)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_small_chunks_of_a_cell():
    """Marks of one row and few wedges at once find the same."""
    pairs = np.array([p for p in _graph() if p[0] != p[1]], np.int64)
    import pyarrow as pa

    table = pa.Table.from_batches(G._pack(1)(iter([pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])])))
    cell = G._Cell(table)
    count = lambda marks, wedges: sum(len(t[0]) for t in cell.triangles(marks, wedges))
    assert count(1, 1) == count(1 << 23, 1 << 21) > 20
    assert sum(len(c[0]) for c, _ in cell.cliques(4, 1)) == sum(len(c[0]) for c, _ in cell.cliques(4)) > 20


@pytest.mark.parametrize("undirected", [False, True])
def test_clustering_shuffles_no_wedges(spark, undirected):
    pairs = [p for p in _graph() if not undirected or p[0] < p[1]]
    both = {*pairs} | ({(b, a) for a, b in pairs} if undirected else set())
    out = {x: {b for a, b in both if a == x} for x in {x for p in pairs for x in p}}
    want = {x: (len(ns), sum((a, b) in both for a in ns for b in ns if a != b) / (len(ns) * (len(ns) - 1))) for x, ns in out.items() if len(ns) >= 2}
    cells = spark.createDataFrame(pairs, "i long, j long")
    got = G.clustering(cells, undirected=undirected)
    assert {r.id: (r.k, r.coefficient) for r in got.collect()} == want
    assert {r.id.id: (r.k, r.coefficient) for r in G.clustering(cells.selectExpr("7L AS g", "i", "j"), "g", undirected).collect()} == want  # by joins
    plan = G.clustering(spark.createDataFrame([p for p in pairs if p[0] != p[1]], "i long, j long"), undirected=undirected)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.count("Join") == 1  # of the counts alone

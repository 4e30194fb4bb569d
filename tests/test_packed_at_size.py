"""Ranks and clusters of large graphs by products with packed edges, of which no round makes rows."""

import numpy as np
import pyarrow as pa
import pytest

from loomspark.operators import graph as G
from loomspark.operators import packed as P
from loomspark.operators import vectors as V
from loomspark.plans import catalogue
from loomspark.sources.scratch import cutter


def _rows(n=400, seed=8):
    rng = np.random.default_rng(seed)
    ends = rng.integers(0, 60, (n, 2)) * np.array([1, 1]) + 10**12
    return [(int(g), int(a), int(b), float(w)) for g, (a, b), w in zip(rng.integers(0, 2, n), ends, rng.random(n).round(6))] + [(0, 10**12, 10**12, 2.5), (0, -5, 10**12, 1 / 3)]


def test_packed_edges_are_the_edges(spark):
    """Far ids, several graphs, weights of six decimals and others: the same rows, and a few bytes each."""
    rows = _rows()
    chunks = P.pack(spark.createDataFrame(rows, "graph_id long, src long, dst long, weight double").repartition(3)).localCheckpoint()
    assert sorted(map(tuple, P.unpack(chunks).collect())) == sorted(rows)
    assert {r.id for r in P.ends(chunks).collect()} == {x for r in rows for x in r[1:3]}
    big = np.arange(70_000, dtype=np.int64)
    batch = next(P.packed(iter([(np.zeros(70_000, np.int64), big, big + 1, np.full(70_000, 0.25))])))
    ids, a, b, w = P._opened(batch, 0)
    assert (ids[a] == big).all() and (ids[b] == big + 1).all() and (w == 0.25).all() and batch.column("w")[0].as_buffer().size == 4 * len(big)


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("most_broadcast", [1_000_000, 10])
def test_large_graphs_ranks_make_no_rows_of_edges(spark, monkeypatch, directed, most_broadcast):
    """Beyond a task's bound ranks equal those of one task, and go by products; beyond the bound of a broadcast by joins. The old code always went by joins."""
    edges = spark.createDataFrame([*_rows(), (1, None, 3, 1.0), (0, 10**12 + 4, 10**12 + 5, None)], "graph_id long, src long, dst long, weight double")
    nodes = spark.createDataFrame([(g, 10**12 + i) for g in (0, 1, 2) for i in range(70)], "graph_id long, id long")
    want = {(r.graph_id, r.id): round(r.importance, 12) for r in G.pagerank(nodes, edges, iterations=20, tol=None, directed=directed).collect()}
    joined, by_joins, by_products = [], G.pagerank_shuffled, G.pagerank_packed
    monkeypatch.setattr(G, "pagerank_shuffled", lambda *args: joined.append(1) or by_joins(*args))
    monkeypatch.setattr(G, "pagerank_packed", lambda *args: by_products(*args, most_broadcast))
    got = G.ranked(nodes, edges, cutter(spark, "t"), directed=directed, most_rows=100)
    assert {(r.graph_id, r.id): round(r.importance, 12) for r in got.collect()} == want
    assert len(joined) == (0 if most_broadcast > 100 else 2)


@pytest.mark.parametrize("name", ["ana_pagerank_directed", "ana_importance_p75", "ana_importance_histogram"])
def test_ranking_queries_pack_their_pairs(spark, sf_dir, monkeypatch, name):
    """The queries hand packed pairs over, so that no row is made for a pair; the old ones handed rows over."""
    seen = []
    full = G.ranked
    monkeypatch.setattr(G, "ranked", lambda *args, chunks, **more: seen.append((chunks.columns, more)) or full(*args, chunks=chunks, **more))
    assert catalogue.queries()[name](spark, sf_dir).count() > 0
    assert seen == [(["graph_id", "n", "ids", "a", "b", "w"], {"directed": True} if name.endswith("directed") else {})]


def test_similar_chunks_are_the_pairs(spark):
    vecs = np.random.default_rng(1).normal(size=(300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    want = {(r.src, r.dst, round(r.weight, 6)) for r in V.similar_pairs(rows, 1.0, block_rows=8).collect()}
    assert {(r.src, r.dst, r.weight) for r in P.unpack(V.similar_chunks(rows, 1.0, block_rows=8)).collect()} == want and len(want) > 1000


@pytest.mark.parametrize("scale", [1.0, 1e-3, 3e4, 1e200])
def test_products_at_the_threshold(scale):
    """Products within rounding of the threshold, of short, long and huge vectors, are decided in doubles, whatever a slice keeps."""
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(200, 7)) * scale
    with np.errstate(over="ignore"):
        prod = np.einsum("ik,jk->ij", vecs[:100], vecs[100:])
    for threshold in (float(np.sort(prod.ravel())[k]) for k in (-3, -200, 300)):
        batch = pa.table({"x": [0] * 200, "y": [1] * 200, "dim": [7] * 200, "id": [*range(200)], "vec": vecs.tolist(), "is_row": [True] * 100 + [False] * 100}).to_batches()
        found = pa.Table.from_batches(V._block_pairs(threshold * (1 - 1e-12) if threshold > 0 else threshold * (1 + 1e-12), 1500, 64)(iter(batch)))
        assert {(a, b - 100) for a, b in zip(found["src"].to_pylist(), found["dst"].to_pylist())} == set(zip(*(x.tolist() for x in np.nonzero(prod >= threshold))))

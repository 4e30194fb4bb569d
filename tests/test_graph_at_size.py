"""Graph operators where counts, thresholds and paths differ from those of small tables."""

import numpy as np
import pyarrow as pa
import pytest

from loomspark.operators import graph as G
from loomspark.operators import vectors as V
from loomspark.plans import catalogue


def test_pattern_hubs_of_more_nodes_than_an_int_squares(spark):
    cells = spark.createDataFrame([(0, j, 1.0) for j in range(1, 6)], "i long, j long, w double")
    got = {r.id for r in G.pattern_hubs(cells, 50_000).collect()}
    assert got == {0, 1, 2, 3, 4, 5}


def test_simplices_at_the_threshold(spark):
    """(0.1 + 0.2) / 2 is a little more than 0.15 in doubles, 0.3 / 2 isn't: neither is over 0.15."""
    cells = spark.createDataFrame([(7, 0, 1, 0.1), (7, 1, 0, 0.2), (8, 0, 1, 0.3), (9, 0, 1, 0.1), (9, 1, 0, 0.2001)], "g long, i long, j long, w double")
    assert [r.g for r in G.simplices(cells, 32, 0.15, "g").filter("dim = 1").collect()] == [9]


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("most_broadcast", [0, 100])
def test_large_graphs_ranks_equal_small_ones(spark, tmp_path, directed, most_broadcast):
    """Loops, repeated edges, null weights and ends, and nodes without edges: the same ranks by joins as in one task; edges are written once and never shuffled."""
    ends = [(0, 1), (1, 2), (2, 2), (2, 0), (0, 1), (3, 0), (4, 4), (None, 1)]
    edges = spark.createDataFrame([(5, a, b, None if a == 2 else 0.5 + k) for k, (a, b) in enumerate(ends)], "graph_id long, src long, dst long, weight double")
    nodes = spark.createDataFrame([(5, i) for i in (0, 1, 2, 3, 4, 6, 6)], "graph_id long, id long")
    steps = []

    def cut(df, k):
        steps.append(k)
        df.write.parquet(f"{tmp_path}/{directed}-{k}")
        return spark.read.parquet(f"{tmp_path}/{directed}-{k}")

    small = {r.id: round(r.importance, 9) for r in G.pagerank(nodes, edges, iterations=20, tol=None, directed=directed).collect()}
    large = {r.id: round(r.importance, 9) for r in G.pagerank_shuffled(nodes, edges, cut, directed=directed, most_broadcast=most_broadcast).collect()}
    assert small == large and steps == ["edges", "nodes", *range(20)]


def test_ranking_queries_send_large_graphs_to_joins(spark, sf_dir, monkeypatch):
    """The queries of ranks go through `ranked`: a graph beyond a task's bound isn't gathered in one."""
    seen = []
    monkeypatch.setattr(G, "ranked", lambda nodes, edges, cut, **more: seen.append(1) or G.pagerank(nodes, edges, iterations=1, tol=None))
    for name in ("ana_pagerank20", "ana_pagerank_directed", "ana_classify", "ana_importance_p75", "ana_importance_histogram"):
        catalogue.queries()[name](spark, sf_dir)
    assert len(seen) == 5


def test_similar_pairs_by_slices(spark):
    """A cell's products come in slices of bounded size, and blocks grow beyond 16 of them; the pairs are those of one product."""
    vecs = np.random.default_rng(1).normal(size=(300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    want = {(i, j) for i, j in zip(*np.nonzero(vecs @ vecs.T > 1.0)) if i < j}
    got = V.similar_pairs(rows, 1.0, block_rows=8)
    assert {(r.src, r.dst) for r in got.collect()} == want and got.count() == len(want)
    assert V._grid(rows, 8, 8).agg({"y": "max"}).first()[0] == 15
    batch = pa.table({"x": [0] * 600, "y": [1] * 600, "dim": [4] * 600, "id": [*range(300)] * 2, "vec": vecs.tolist() * 2, "is_row": [True] * 300 + [False] * 300}).to_batches()
    parts = [b.num_rows for b in V._block_pairs(1.0, 3000)(iter(batch))]
    assert len(parts) == 30 and sum(parts) == (vecs @ vecs.T > 1.0).sum()


def test_spread_sample_orders_few_edges(spark, monkeypatch):
    """Only edges of the few src that hold the asked places are ordered; the sample is that of all edges in order, hubs and repeated edges too."""
    pairs = sorted([(i % 97, (i * 31) % 89) for i in range(1500)] + [(5, j) for j in range(400)] + [(6, 1)] * 30)
    e = spark.createDataFrame(pairs, "src long, dst long").repartition(7)
    ordered = []
    full = G.ranked_rows
    monkeypatch.setattr(G, "ranked_rows", lambda rows, *more: ordered.append(rows.count()) or full(rows, *more))
    for most in (20, 7, 1, 3000):
        stride = max(1, len(pairs) // most)
        assert sorted(map(tuple, G.spread_sample(e, most).collect())) == pairs[::stride][:most]
    assert ordered[1] < len(pairs) / 2
    assert G.spread_sample(e.limit(0)).count() == 0


def test_stars_within_tasks(spark, tmp_path):
    """A dense graph's edges leave a task as one star for each component, whatever the bound on what is held."""
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 200, 5000) * 4 + np.arange(5000) % 4 for _ in "ab")
    batches = [pa.record_batch([a[i : i + 500], b[i : i + 500]], ["src", "dst"]) for i in range(0, 5000, 500)]
    for most in (1 << 20, 600):
        got = pa.Table.from_batches(G._local_forest(iter(batches), most))
        ids, low = G._smallest_reached(got["src"].to_numpy(), got["dst"].to_numpy())
        want, want_low = G._smallest_reached(a, b)
        assert (ids == want).all() and (low == want_low).all() and (low == ids % 4).all()
    assert pa.Table.from_batches(G._local_forest(iter(batches))).num_rows == 800 - 4
    assert [(r.id, r.comp) for r in G.component_labels(spark.createDataFrame([*zip(a.tolist(), b.tolist())], "src long, dst long"), lambda df, k: df.localCheckpoint()).orderBy("id").limit(6).collect()] == [(i, i % 4) for i in range(6)]


def test_components_contract_by_rounds(spark):
    """What all rounds write is a few times the first round's edges and ids, however far apart the ids of a component are; chains in the ids' order, stars,
    texts as ids and shuffled labels give the same components."""
    from loomspark.sources.scratch import cutter

    rng = np.random.default_rng(4)
    mixed, drawn = rng.permutation(1000).tolist(), rng.integers(2000, 2600, (400, 2)).tolist()
    edges = [*zip(mixed, mixed[1:])] + [(a, b) for a, b in drawn if a != b]
    ids, low = G._smallest_reached(*np.array(edges).T)
    rows = {}

    def cut(df, step, write=cutter(spark, "rounds")):
        out = write(df, step)
        rows[step] = out.count()
        return out

    e = spark.createDataFrame([(f"{a:04}", f"{b:04}") for a, b in edges], "src string, dst string")
    got = {(r.id, r.comp) for r in G.component_labels(e, cut).collect()}
    assert got == {(f"{i:04}", f"{c:04}") for i, c in zip(ids.tolist(), low.tolist())}
    assert sum(rows.values()) < 4 * (2 * len(edges) + len(ids)), rows
    ordered = [(k, k + 1) for k in range(150)] + [(290, k) for k in range(200, 300) if k != 290]
    for kind, most in (("long", 0), ("string", 50_000)):
        name = (lambda x: x) if kind == "long" else (lambda x: f"{x:03}")
        e = spark.createDataFrame([(name(a), name(b)) for a, b in ordered], f"src {kind}, dst {kind}").repartition(6)
        got = {(r.id, r.comp) for r in G.component_labels(e, cutter(spark, "t"), most).collect()}
        assert got == {(name(k), name(0)) for k in range(151)} | {(name(k), name(200)) for k in range(200, 300)}

"""Spectral clusters without a matrix of all edges both ways."""

import numpy as np
import pytest

from loomspark.operators import packed, spectral


@pytest.mark.parametrize("most_broadcast", [0, 1000])
def test_edges_stand_for_the_matrix(spark, tmp_path, most_broadcast):
    """Loops, repeated and turned edges, null and zero weights: eigenvalues and spans as of the normalised matrix; edges are written once, as they are."""
    rng = np.random.default_rng(6)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.random(200))]
    rows += [(3, 4, None), (None, 4, 1.0), (1, 2, 0.0), (1, 2, -1.0), *rows[:20], *[(b, a, w) for a, b, w in rows[20:40]]]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    steps = {}

    def cut(df, k):
        df.write.parquet(f"{tmp_path}/{k}")
        steps[k] = spark.read.parquet(f"{tmp_path}/{k}")
        return steps[k]

    _, want = spectral.smallest_eigenvectors(spectral.normalised(edges), 3, rounds=12, extra=9)
    vectors, got = spectral.smallest_eigenvectors_of_edges(edges, 3, rounds=12, extra=9, cut=cut, most_broadcast=most_broadcast)
    assert np.abs(want - got).max() < 1e-9 and vectors.count() == 30
    assert steps["edges"].count() == len(rows) - 4 and "matrix" not in steps


def test_chunks_stand_for_the_matrix(spark, monkeypatch):
    """Loops and repeated edges: eigenvalues as of the matrix in numpy, with the block on the driver; beyond its bound the edges go by joins."""
    rng = np.random.default_rng(6)
    rows = [(0, int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.random(200) + 0.1)]
    rows += rows[:9] + [(0, 3, 3, 0.5)]
    full = np.zeros((30, 30))
    for _, a, b, w in rows:
        full[a, b] += w
        full[b, a] += w * (a != b)
    root = np.sqrt(full.sum(axis=1))
    want = np.linalg.eigvalsh(np.eye(30) - full / root[:, None] / root)
    chunks = packed.pack(spark.createDataFrame(rows, "graph_id long, src long, dst long, weight double"))
    vectors, got = spectral.smallest_eigenvectors_of_chunks(chunks, 3, rounds=14, extra=20)
    assert np.abs(want[:3] - got).max() < 1e-6
    v = np.array([r.v for r in vectors.orderBy("id").collect()])
    assert np.abs(v - (full / root[:, None] / root) @ v - v * got).max() < 1e-2 and np.abs(v.T @ v - np.eye(3)).max() < 1e-6
    seen = []
    monkeypatch.setattr(spectral, "smallest_eigenvectors_of_edges", lambda edges, *more: seen.append(edges.count()) or (edges, None))
    spectral.smallest_eigenvectors_of_chunks(chunks, 3, most_held=10)
    assert seen == [len(rows)]

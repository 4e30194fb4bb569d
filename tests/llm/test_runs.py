import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import periodic_runs as pr


def brute_runs(ids, least=12):
    """Every period, every stretch of places that equal those a period on."""
    best = {}
    for p in range(1, len(ids) // 2 + 1):
        i = 0
        while i < len(ids) - p:
            a = i
            while i < len(ids) - p and ids[i] == ids[i + p]:
                i += 1
            if i - a >= p and i - a + p >= least:
                best.setdefault((a, i - a + p), p)
            i += 1
    return sorted((a, n, p) for (a, n), p in best.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.tuples(st.integers(0, 59), st.integers(1, 25), st.integers(2, 60)), max_size=3), st.sampled_from([2, 5, 12]))
def test_runs_are_those_of_brute_force(ids, repeats, least):
    for a, p, n in repeats:
        for i in range(a, min(a + n, len(ids))):
            ids[i] = ids[a + (i - a) % p]
    assert pr.find_runs(np.array(ids, np.int32), least) == brute_runs(ids, least)


def test_long_texts():
    n = 200_000
    assert pr.find_runs(np.zeros(n, np.int32)) == [(0, n, 1)]
    ids = np.arange(n, dtype=np.int32)
    ids[1000:151_000] = ids[1000 + np.arange(150_000) % 50_000]
    assert pr.find_runs(ids) == [(1000, 150_000, 50_000)]


def brute_row(doc_id, text):
    words = pr.planted((text or "").encode().split(), doc_id)
    runs = brute_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice("abcdé") for _ in range(rng.randrange(80)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "x " * 500), (204, "A a " * 30), (205, "p q " * 12), (205, "p q " * 12), (None, "u v " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, pr.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((brute_row(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(150))


def test_defined_cases(spark, docs, no_docs, hard_docs):
    out = pr.periodic_runs(docs.withColumns({"runs": docs.doc_id, "extra": docs.lang}))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == len(hard_docs)
    for r in rows:
        words = (r.text or "").encode().split()
        assert [tuple(x) for x in r.runs] == (brute_runs(words) if len(words) < 2000 else [(0, 40_000, 977)])
    assert pr.periodic_runs(no_docs).count() == 0


def test_a_wrong_grid_is_seen(monkeypatch):
    """The probes decide: without them nothing is found."""
    monkeypatch.setattr(pr, "_probes", lambda ids, low, high: (np.empty(0, np.int64),) * 2)
    assert pr.find_runs(np.zeros(50, np.int32)) == []


@pytest.mark.parametrize("least", [2, 12])
def test_nested_and_touching_runs(least):
    ids = [1, 1, 1, 1, 2] * 6 + [3, 4] * 8 + [4, 3] * 8
    assert pr.find_runs(np.array(ids, np.int32), least) == brute_runs(ids, least)

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from loomspark.llm import near_dedup as N

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: float("inf"))
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], -(2**63) if r[0] is None else r[0])
    return [(r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows)]


def run(spark, rows, **options):
    got = N.near_duplicates(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), **options).collect()
    return sorted(((r.doc_id, r.n_shingles, -(2**63) if r.component_id is None else r.component_id) for r in got), key=str), got


def families(seed=3, groups=(2, 3, 12, 90), words=60):
    """Copies with a few changed words each, of several groups, and unrelated texts with a shared passage."""
    rng, rows = random.Random(seed), []
    shared = " ".join(f"common{k}" for k in range(12))
    for g, n in enumerate(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(n):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"edit{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + k, " ".join(f"u{k}x{j}" for j in range(40)) + " " + shared) for k in range(20)]
    return rows


def test_hard_cases(spark, hard_docs):
    got, raw = run(spark, hard_docs)
    assert got == sorted(brute(hard_docs), key=str)
    assert all(r.kept for r in raw if r.n_shingles == 0)


@pytest.mark.parametrize("bounds", [{}, {"cell_rows": 20}, {"filter_bits": 1 << 20, "cell_bytes": 4000}])
def test_families_that_fit_cells_and_others(spark, bounds):
    rows = families()
    got, _ = run(spark, rows, **bounds)
    assert got == sorted(brute(rows), key=str)


def test_blocks_of_large_families(spark):
    rows = families(5, (700,), 40)
    got, _ = run(spark, rows)
    assert got == sorted(brute(rows), key=str)


def test_pages_that_share_boilerplate(spark):
    """Half of each page is the same: one family of the sketches, none of them linked; some have near copies."""
    rng = random.Random(8)
    plate = " ".join(f"plate{k}" for k in range(40))
    rows = [(k, plate + " " + " ".join(f"p{rng.randrange(10**9)}" for _ in range(35))) for k in range(300)]
    rows += [(300 + k, rows[k][1] + " more") for k in range(0, 300, 30)]
    got, _ = run(spark, rows, cell_rows=40)
    assert got == sorted(brute(rows), key=str) and len({c for _, _, c in got}) == 300


def test_very_long_texts_in_a_family(spark):
    base = [f"w{k}" for k in range(30_000)]
    rows = [(k, " ".join(base[: 30_000 - 1500 * k])) for k in range(8)] + [(8, " ".join(base[:300]))]
    for options in ({}, {"cell_bytes": 100_000}):
        got, _ = run(spark, rows, **options)
        assert got == sorted(brute(rows), key=str)


@pytest.mark.parametrize("words,percent", [(1, 50), (3, 90)])
def test_other_words_and_thresholds(spark, words, percent, monkeypatch):
    rows = [r for r in families(11, (3, 9), 30)]
    got, _ = run(spark, rows, words=words, percent=percent, cell_rows=6)

    def cut(text):
        w = text.split()
        return frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1)))

    sets = {r[0]: cut(r[1]) for r in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == sorted(((i, len(sets[i]), comp[i]) for i in sets), key=str)


def test_overlaps_and_estimates_against_plain_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, size=rng.integers(5, 200))) for _ in range(40)]
    rows, cols = np.arange(0, 25), np.arange(15, 40)
    sketches = [x[:64] for x in sets]
    shared = N._overlaps(sketches, rows, cols, most=50)
    assert all(shared[i, j] == len(set(sketches[r]) & set(sketches[c])) for i, r in enumerate(rows) for j, c in enumerate(cols))
    padded = np.full((40, 64), np.iinfo(np.int64).max)
    for i, x in enumerate(sketches):
        padded[i, : len(x)] = x
    a, b = rng.integers(0, 40, 200), rng.integers(0, 40, 200)
    for p, q, est in zip(a, b, N._estimates(padded, a, b, 64)):
        union = sorted({*sketches[p].tolist(), *sketches[q].tolist()})[:64]
        assert est == len(set(union) & set(sketches[p].tolist()) & set(sketches[q].tolist())) / len(union)


def test_one_row_of_each_component_stays(spark, docs, hard_docs):
    kept = N.drop_near_duplicates(docs).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(13) == 0 and None in ids and 14 not in ids  # linked with the null id, which is the smallest
    assert {10, 11, 12} <= set(ids)
    assert set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_clashing_columns_stay(docs):
    clash = docs.selectExpr("*", "1 AS node", "2 AS n", "3 AS kept", "4 AS component", "5 AS th")
    out = N.drop_near_duplicates(clash)
    assert out.columns == clash.columns and {(r.node, r.n, r.kept) for r in out.collect()} == {(1, 2, 3)}


def test_empty_table(no_docs):
    assert N.near_duplicates(no_docs).count() == 0

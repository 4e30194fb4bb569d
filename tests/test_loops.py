import random
import re

import numpy as np

from loomspark.operators import refine, spectral, tree
from loomspark.operators import segment as S
from loomspark.plans.graph_plans import lines
from loomspark.sources.scratch import cutter

SCHEMA = "doc_id long, text string"


def brute_split_merge(text, target, slack=1.2, rounds=5):
    most = int(slack * target)
    ps, done = [text.strip(" \t\n\r\x0b\x0c")], 0
    if not ps[0]:
        return None
    for k in range(rounds):
        if sum(map(len, ps)) <= most * len(ps):
            break
        split = [
            lambda p: re.split(r"(?<=[.!?])[ \t\n\r\x0b\x0c]+|\n\n+", p),
            lambda p: re.split(r"(?<=[,;:])[ \t\n\r\x0b\x0c]+", p),
            lambda p: re.split(r"(?=<\|)", p),
            lambda p: [p[s : s + target] for s in range(0, len(p), target)],
        ][min(k, 3)]
        parts = [x.strip(" \t\n\r\x0b\x0c") for p in ps for x in (split(p) if len(p) > target else [p])]
        out = []
        for p in filter(None, parts):
            if out and len(out[-1]) + 1 + len(p) <= most:
                out[-1] += " " + p
            else:
                out.append(p)
        done, same = k + 1, out == ps
        ps = out
        if k >= 3 and same:
            break
    return done, ps


def test_split_and_merge_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice(["ab", "cde", " ", ". ", ", ", "\n\n", "<|x|>", "é"]) for _ in range(rng.randrange(120)))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "x" * 500), (104, "y" * 41), (104, "z. " * 60)]
    got = {}
    for r in refine.split_and_merge(spark.createDataFrame(rows, SCHEMA), target=20).orderBy("doc_id", "ord").collect():
        if r.doc_id != 104:
            got.setdefault(r.doc_id, (r["round"], []))[1].append(r.content)
    expected = {k: b for k, t in rows if k != 104 and t is not None and (b := brute_split_merge(t, 20))}
    assert got == expected
    assert refine.split_and_merge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rounds_end_when_all_are_done(spark):
    written = []
    cut = cutter(spark, "test")
    refine.split_and_merge(spark.createDataFrame([(1, "short")], SCHEMA), cut=lambda df, k: written.append(k) or cut(df, k))
    assert written == [0]


def test_frontier_equals_building_at_once_and_leaves_no_duplicates(spark):
    text = "a\nb\n\nc\n\nd\ne\nf"
    docs = spark.createDataFrame([(1, text), (2, "one"), (3, None)], SCHEMA)
    cut = cutter(spark, "test")
    begun, done = tree.grow(tree.roots(docs), [S.paragraphs], lambda df, k: cut(df, f"a{k}"))
    assert {r.level for r in begun.collect()} == {0, 1}
    grown, every = tree.grow(begun, [S.paragraphs, lines], lambda df, k: cut(df, f"b{k}"), done)
    at_once, _ = tree.grow(tree.roots(docs), [S.paragraphs, lines], lambda df, k: cut(df, f"c{k}"))
    rows = sorted(map(tuple, grown.collect()), key=repr)
    assert rows == sorted(map(tuple, at_once.collect()), key=repr)
    assert len({r[:2] for r in rows}) == len(rows)
    pairs = [tuple(r) for r in every.collect()]
    assert len(set(pairs)) == len(pairs) == 2 * len(rows)
    again, _ = tree.grow(grown, [S.paragraphs, lines], lambda df, k: cut(df, f"d{k}"), every)
    assert again.count() == len(rows)


def graph(rng, sizes, inside, between):
    n = sum(sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, [(a, b, rng.random() + 0.5) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if of[a] == of[b] else between)]


def test_eigenvalues_are_numpys(spark):
    rng = random.Random(4)
    _, edges = graph(rng, [9, 7, 8], 0.7, 0.15)
    edges += [(0, 0, 2.0), (3, 1, 0.5), (1, 3, 0.5)]
    n = 24
    a = np.zeros((n, n))
    for x, y, w in edges:
        a[x, y] += w
        if x != y:
            a[y, x] += w
    d = a.sum(1)
    lap = np.eye(n) - a / np.sqrt(d[:, None] * d[None])
    expected = np.linalg.eigvalsh(lap)[:3]
    rows = [*edges, (5, 6, 0.0), (5, 6, -1.0), (None, 1, 1.0), (1, 2, None)]
    vectors, values = spectral.smallest_eigenvectors(spectral.normalised(spark.createDataFrame(rows, "src long, dst long, weight double")), 3, rounds=14, extra=12)
    assert np.abs(values - expected).max() < 1e-3
    v = np.array([r.v for r in vectors.orderBy("id").collect()])
    assert np.abs(lap @ v - v * values).max() < 0.1


def test_planted_blocks_are_recovered(spark):
    sizes = (20, 8, 14)
    of, edges = graph(random.Random(len(sizes)), sizes, 0.8, 0.03)
    got = {r.id: r.cluster for r in spectral.spectral_clusters(spark.createDataFrame(edges, "src long, dst long, weight double"), len(sizes), rounds=12).collect()}
    assert [got[k] for k in range(len(of))] == of.tolist()


def test_no_edges(spark):
    assert spectral.spectral_clusters(spark.createDataFrame([], "src long, dst long, weight double"), 3).count() == 0

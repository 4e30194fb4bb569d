import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import importance as im
from loomspark.llm.common import Scratch


def words(text, most=1):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return len(w), [b" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent, least, most=1, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in words(x, most)[1]) for texts in ([r[1] for r in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    scored = []
    for k, text in rows:
        n, f = words(text, most)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        scored.append([k, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = [r for r in scored if r[1] >= least]
    drawn = sorted(able, key=lambda r: (-r[4], -(2**63) if r[0] is None else r[0]))[: percent * len(able) // 100]
    place = {id(r): p for p, r in enumerate(drawn, 1)}
    return sorted(((r[0], *r[2:], place.get(id(r))) for r in scored), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["Alpha", "beta", "γάμμα", "d1", "e-f", "g", "h", "I"]) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("most,percent", [(1, 10), (2, 55), (3, 100), (1, 0)])
def test_against_brute_force(spark, most, percent):
    rows = [*enumerate(texts(300, most)), (900, None), (901, ""), (902, "..."), (None, "alpha beta " * 30)]
    target = texts(20, 99)
    out = im.importance_resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in [*target, None]], "text string"), percent, 20, most, run_rows=40, range_rows=25)
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows, target, percent, 20, most)


def test_tournament():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 8, 33):
        pieces = [sorted((rng.randrange(50), rng.randrange(3), i) for i in range(rng.randrange(20))) for _ in range(k)]
        every = sorted(x for p in pieces for x in p)
        for most in (0, 1, 5, 1000):
            assert list(im.tournament(pieces, most)) == every[:most]


@pytest.mark.parametrize("rows,run_rows,range_rows,parts", [(5000, 100, 300, 3), (5000, 10**6, 64, 7), (300, 7, 10, 40), (50, 10, 10, 1)])
def test_draw_over_runs_and_ranges(spark, rows, run_rows, range_rows, parts):
    """Ties, repeated ids and a score that a third of all rows have."""
    rng = random.Random(rows)
    keys = [(5 if rng.random() < 0.33 else rng.randrange(-50, 50), rng.randrange(rows // 2), k) for k in range(rows)]
    scored = spark.createDataFrame(keys, "score long, id long, tag long").repartition(parts)
    expected = [t for _, _, t in sorted((-s, i, t) for s, i, t in keys)]
    for drawn in (0, 1, rows // 10, rows):
        got = sorted((r.rank, r.tag) for r in im.draw(scored, drawn, Scratch(spark, "test"), run_rows, range_rows).collect())
        assert got == [(k, t) for k, t in enumerate(expected[:drawn], 1)]


def test_defined_cases(spark, docs, no_docs, hard_docs):
    target = spark.createDataFrame([("long1 long2 own",)], "text string")
    out = im.importance_resample(docs.withColumn("rank", docs.lang), target, 50, 1)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_features", "weight", "score", "rank"]
    rows = out.collect()
    able = [r for r in rows if r.n_features >= 1]
    assert len(rows) == len(hard_docs) and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, len(able) // 2 + 1))
    assert {(r.doc_id, r.n_features, r.weight, r.score) for r in rows} == {x[:4] for x in brute([(r[0], r[1]) for r in hard_docs], ["long1 long2 own"], 50, 1)}
    assert im.importance_resample(no_docs, target).count() == 0
    assert im.importance_resample(docs, target.limit(0)).count() == len(hard_docs)


def test_gains_of_empty_target_are_those_of_uniform_shares():
    assert im.gains(np.array([3, 0]), np.array([0, 0])).tolist() == [math.floor(1000 * math.log(5 / 8)), math.floor(1000 * math.log(5 / 2))]

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import suffix_dedup as sd

FIELDS = "doc_id long, text string"


def brute(rows, length):
    """kept, removed and spans of each row, from all strings of `length` bytes."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (k, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        out.append((k, len(t), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone[1:]) if not g)).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, length, **more):
    out = sd.remove_repeats(spark.createDataFrame(rows, FIELDS), length, **more).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out), key=repr)


def corpus(seed, n=60):
    """Texts of few letters that share passages of all sizes, near copies, copies and periodic stretches."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé\0") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randrange(3, 30))) for _ in range(8)]
    rows = []
    for k in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        if rng.random() < 0.1:
            parts.append(word() * rng.randrange(40))
        rows.append((k, " ".join(parts)))
    near = list(rows[3][1] or passages[0])
    for k in range(8):
        near[rng.randrange(len(near))] = "x"
        rows.append((100 + k, "".join(near)))
    return [*rows, (200, None), (201, ""), (202, "ab"), (203, rows[5][1]), (203, rows[5][1]), (None, rows[6][1]), (None, passages[1])]


@pytest.mark.parametrize("length,anchor", [(16, 8), (25, 8), (40, 20)])
def test_against_brute_force(spark, length, anchor):
    rows = corpus(length)
    assert run(spark, rows, length, anchor=anchor) == brute(rows, length)


def test_small_families_and_groups(spark):
    """All anchor strings but the rarest go by their windows; the rest in many families."""
    rows = corpus(3)
    assert run(spark, rows, 20, anchor=8, family_rows=3, group_rows=3) == brute(rows, 20)
    assert run(spark, rows, 20, anchor=8, group_rows=1, filter_bits=1 << 10) == brute(rows, 20)


def test_long_texts_are_cut(monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 256)
    rng = random.Random(5)
    long_ = bytes(rng.choice(b"abc") for _ in range(5000))
    texts = [long_, b"z" * 30 + long_[700:1500] + b"y" * 500, b"q" * 10]
    found = []
    for data, parts in sd._chunks(texts, 50):
        assert len(data) <= 256 + 50
        found += [(k, lo + i) for (k, at, lo), end in zip(parts, [*[p[1] for p in parts[1:]], len(data)]) for i in range(end - at - 49)]
    assert sorted(found) == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 49)]


@pytest.mark.parametrize("batch", [1, 3, 7, 100])
def test_family_finds_all_pairs(batch):
    """Segments with one anchor string, added in batches of any size: a window is marked if it stands in two of them."""
    rng = random.Random(batch)
    length, anchor = 24, 8
    rows = []
    for _ in range(70):
        left, right = (bytes(rng.choice(b"ab\0") for _ in range(16)) for _ in range(2))
        at = rng.randrange(17)
        more = rng.randrange(at + 1)
        rows.append(((left[16 - at :] + b"ANCHORED" + right)[: more + length].ljust(more + length, b"e"), at, more, rng.random() < 0.1))
    family = sd.Family(length, anchor)
    for lo in range(0, len(rows), batch):
        family.add(*map(list, zip(*rows[lo : lo + batch])))
    assert all(len(a.rows) > len(b.rows) for a, b in zip(family.levels, family.levels[1:]))
    seen = Counter((at - j, t[j : j + length]) for t, at, more, _ in rows for j in range(more + 1))
    for (t, at, more, repeated), flags in zip(rows, family.windows()):
        for before in range(17):
            j = at - before
            expected = -1 if not 0 <= j <= more else int(repeated or seen[before, t[j : j + length]] > 1)
            assert flags[before] == expected


def test_defined_cases(spark, docs, no_docs, hard_docs):
    out = sd.remove_repeats(docs.withColumn("n_spans", docs.lang), 200)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "kept", "n_bytes", "n_removed", "n_spans"]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in hard_docs], 200)
    assert sd.remove_repeats(no_docs, 200).count() == 0
    with pytest.raises(ValueError):
        sd.remove_repeats(docs, 100, anchor=64)


def test_the_scan_of_merged_arrays_decides(monkeypatch):
    monkeypatch.setattr(sd, "mark", lambda array, length: None)
    family = sd.Family(24, 8)
    family.add([b"a" * 10 + b"ANCHORED" + b"b" * 16] * 2, [10, 10], [10, 10], [False, False])
    assert (family.windows() <= 0).all()

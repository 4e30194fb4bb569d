"""Toxicity: a support vector machine on a gapped-subsequence string kernel with Nystroem landmarks, trained on sentences.

A text is cut into sentences, and a sentence is a bag of windows: one to three neighbouring words of at most SPAN bytes, with the
separators around them. Two windows are alike by the three-byte subsequences that they share, each with up to two bytes between
neighbours and decaying with its spread, so insults with gaps or inserted characters stay near their plain form; marks inside
words are left out, and letters set apart by spaces count as one word. A sentence is as toxic as its worst window.

All sentences of clean documents are labelled clean. Of a toxic document's sentences the worst are its witnesses: they are picked,
the machine is fitted, and they are picked again. A document's score comes from its worst sentences, and is fitted out of fold.

A kernel expansion over landmarks is linear in the subsequences, so the trained machine is one table of their weights: one pass over
a text's bytes gives running sums of their weights, and a window costs a few differences, whatever the number of landmarks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomspark.llm.common import small_batches, text_bytes
from loomspark.llm.learning import held_out, labelled_sample, logistic, sigmoid, train_in_one_task

LETTERS = 64
SIZE = LETTERS**3
SPAN = 24  # longer words are read in overlapping windows
WORDS = 3
DECAY = 0.6
GAPS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
SPREADS = range(2, 7)  # of the bytes of a subsequence: a + b
LOW = -2.0  # the score of a sentence that isn't there
BYTES = 1 << 16  # of texts that are read at once: their sums fit the processor's cache
STATS = 6

_KIND = np.zeros(256, np.uint8)  # 0: letters, digits, bytes of other scripts
for _k, _bytes in ((1, b" \t\x0b\x0c"), (2, b"\n\r"), (3, b".!?"), (4, b",;:\"'()[]{}<>*_-+=/\\|~`#$%&@^")):
    _KIND[list(_bytes)] = _k
_CODE = np.array([b - 96 if 97 <= b <= 122 else 27 + b % 36 for b in range(256)], np.int32)  # 0 is the separator
_NORM = np.sqrt([max(1e-12, sum(DECAY ** (2 * (a + b - 2)) * max(0, n - a - b) for a, b in GAPS)) for n in range(SPAN + 3)])


class Words:
    """The words of some texts: codes holds them one after another with one separator before, between and behind."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(t.lower() + b"\n" for t in texts) + b"\n", np.uint8)
        self.texts = len(texts)
        kind = _KIND[data]
        kind[:-1][(kind[:-1] == 3) & np.isin(kind[1:], (1, 2))] = 2  # a stop ends a sentence only before white space
        ends = np.cumsum([len(t) + 1 for t in texts])
        stay = kind < 3
        at = np.flatnonzero(stay)
        data, kind = data[stay], kind[stay]
        letter = kind == 0
        first = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
        last = np.flatnonzero(letter & ~np.append(letter[1:], False))
        sizes = last - first + 1
        sentence = np.cumsum(kind == 2)[first] if len(first) else np.zeros(0, np.int64)
        if len(first):
            # letters set apart by spaces: at least four in a row become one word
            same = (sizes[1:] == 1) & (sizes[:-1] == 1) & (sentence[1:] == sentence[:-1])
            run = np.cumsum(np.append(False, ~same))
            head = np.append(True, ~(same & (np.bincount(run)[run[1:]] >= 4)))
            sizes = np.add.reduceat(sizes, np.flatnonzero(head))
            first, sentence = first[head], sentence[head]
        self.doc = np.searchsorted(ends, at[first], side="right").astype(np.int32)
        self.sentence = sentence.astype(np.int32)
        self.begin = (1 + np.cumsum(np.append(0, sizes + 1))[:-1]).astype(np.int32)
        self.end = (self.begin + sizes).astype(np.int32)
        self.codes = np.zeros(1 + int((sizes + 1).sum()), np.int32)
        self.codes[np.arange(letter.sum()) + np.repeat(np.arange(len(sizes)), sizes) + 1] = _CODE[data[letter]]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per number of words and first word: the window's two separators, and whether there is such a window."""
        n = len(self.begin)
        left, right, there = np.zeros((WORDS, n), np.int32), np.zeros((WORDS, n), np.int32), np.zeros((WORDS, n), bool)
        for k in range(min(WORDS, n)):
            left[k, : n - k], right[k, : n - k] = self.begin[: n - k] - 1, self.end[k:]
            there[k, : n - k] = (self.sentence[: n - k] == self.sentence[k:]) & ((right[k, : n - k] - left[k, : n - k] <= SPAN + 1) | (k == 0))
        return left, right, there

    def spans(self, left: int, right: int) -> list[np.ndarray]:
        """A window's codes; those of a long word in overlapping parts."""
        if right - left <= SPAN + 1:
            return [self.codes[left : right + 1]]
        return [self.codes[a : min(a + SPAN + 1, right) + 1] for a in range(left, right - SPAN // 2, SPAN // 2)]

    def scores(self, *tables: np.ndarray) -> list[np.ndarray]:
        """<x, table> of each window for each table, -inf where there is none; the largest of a long word's parts."""
        left, right, there = self.windows()
        long = there & (right - left > SPAN + 1)
        short = np.flatnonzero(there & ~long)
        a, b = left.ravel()[short], right.ravel()[short]
        found = []
        for sums in running_sums(self.codes, tables):
            out = np.full(left.shape, -np.inf)
            out.ravel()[short] = window_sums(sums, a, b)
            for k, i in zip(*np.nonzero(long)):
                at = np.arange(left[k, i], right[k, i] - SPAN // 2, SPAN // 2)
                out[k, i] = window_sums(sums, at, np.minimum(at + SPAN + 1, right[k, i])).max()
            found.append(out)
        return found

    def keys(self) -> np.ndarray:
        """A hash of each window's codes: a polynomial modulo 2^64, from running sums."""
        with np.errstate(over="ignore"):
            base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
            up = np.cumprod(np.append(np.uint64(1), np.full(len(self.codes), base)))
            down = np.cumprod(np.append(np.uint64(1), np.full(len(self.codes), inverse)))
            total = np.append(np.uint64(0), np.cumsum((self.codes + 1).astype(np.uint64) * up[:-1]))
            left, right, _ = self.windows()
            return (total[right + 1] - total[left]) * down[left]


def running_sums(codes: np.ndarray, tables: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """For each table (spreads x places + 1): the weights of all subsequences of a spread that begin before a place."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(6, codes.dtype)])
    out = [np.zeros((len(SPREADS), n + 1)) for _ in tables]
    for a in (1, 2, 3):
        two = (padded[:n] * LETTERS + padded[a : a + n]) * LETTERS
        for b in (1, 2, 3):
            at = two + padded[a + b : a + b + n]
            for sums, table in zip(out, tables):
                sums[a + b - 2, 1:] += table.take(at)
    for sums in out:
        for d in SPREADS:
            np.cumsum(sums[d - 2] * DECAY ** (d - 2), out=sums[d - 2])
    return out


def window_sums(sums: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    total = np.zeros(left.shape)
    for d in SPREADS:
        stop = np.maximum(right - d + 1, left)
        total += sums[d - 2].take(stop) - sums[d - 2].take(left)
    return total / _NORM[right - left + 1]


def subsequences(spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(windows x places) indices and weights of the subsequences; a window's weights have length one."""
    n = SPAN + 2
    codes = np.full((len(spans), n + 6), -1, np.int64)
    for i, s in enumerate(spans):
        codes[i, : len(s)] = s
    index = np.empty((len(spans), n * len(GAPS)), np.int64)
    weight = np.zeros((len(spans), n * len(GAPS)), np.float32)
    for g, (a, b) in enumerate(GAPS):
        x, y, z = codes[:, :n], codes[:, a : a + n], codes[:, a + b : a + b + n]
        ok = z >= 0
        s = slice(g * n, (g + 1) * n)
        index[:, s] = np.where(ok, (x * LETTERS + y) * LETTERS + z, 0)
        weight[:, s] = np.where(ok, DECAY ** (a + b - 2), 0)
    norm = np.sqrt((weight**2).sum(axis=1, keepdims=True))
    return index, weight / np.maximum(norm, 1e-6)


def _kernel_rows(index: np.ndarray, weight: np.ndarray, place: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of windows with landmarks; place: subsequence to row of landmarks, whose last row is zero."""
    out = np.zeros((len(index), landmarks.shape[1]), np.float32)
    for j in range(index.shape[1]):
        rows = np.flatnonzero(weight[:, j])
        if len(rows):
            out[rows] += weight[rows, j][:, None] * landmarks[place[index[rows, j]]]
    return out


def _landmark_table(chosen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences that the landmarks hold, their places, and (places + 1 x landmarks) weights."""
    index, weight = subsequences(chosen)
    used = np.unique(index[weight > 0])
    place = np.full(SIZE, len(used))
    place[used] = np.arange(len(used))
    landmarks = np.zeros((len(used) + 1, len(chosen)), np.float32)
    for j in range(len(chosen)):
        np.add.at(landmarks[:, j], place[index[j]], weight[j])
    landmarks[-1] = 0
    return used, place, landmarks


def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    _, place, landmarks = _landmark_table(b)
    return _kernel_rows(*subsequences(a), place, landmarks)


def _fit(positive: list[np.ndarray], negative: list[np.ndarray], most: int, cost: float) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM in the Nystroem space of landmarks taken from both classes; the collapsed table and the bias."""
    pick = lambda ws, m: [ws[i] for i in np.unique(np.linspace(0, len(ws) - 1, min(m, len(ws))).astype(int))]
    used, place, landmarks = _landmark_table(pick(positive, most // 2) + pick(negative, most // 2))
    gram = landmarks.T.astype(float) @ landmarks
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    spans = positive + negative
    x = np.concatenate([_kernel_rows(*subsequences(spans[k : k + 4096]), place, landmarks) for k in range(0, len(spans), 4096)]) @ root
    x = np.c_[x, np.ones(len(x))]
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = cost * np.where(y > 0, len(y) / (2 * len(positive)), len(y) / (2 * len(negative)))
    w = np.zeros(x.shape[1])
    reg = np.eye(len(w))
    reg[-1, -1] = 1e-6
    for _ in range(20):
        active = y * (x @ w) < 1
        xa, ca = x[active], c[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + reg, (xa * (ca * y[active])[:, None]).sum(axis=0))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    table = np.zeros(SIZE, np.float32)
    table[used] = landmarks[:-1] @ (root @ w[:-1])
    return table, float(w[-1])


def disguised(spans: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """Each window with a byte put in, and with one replaced: virtual examples for the machine."""
    rng = np.random.default_rng(seed)
    out = []
    for s in spans:
        if 5 <= len(s) <= SPAN:
            i, j = (int(rng.integers(2, len(s) - 1)) for _ in range(2))
            out.append(np.insert(s, i, rng.integers(1, 27)))
            other = s.copy()
            other[j] = rng.integers(1, LETTERS - 1)
            out.append(other)
    return out


def _first_table(batches: list[Words], toxic: list[np.ndarray]) -> np.ndarray:
    """Log odds of the subsequences of distinct words, weighed by the documents of each class that hold the word."""
    found = []
    for b, (words, lab) in enumerate(zip(batches, toxic)):
        key = words.keys()[0]
        order = np.lexsort((words.doc, key))
        once = order[np.append(True, (key[order][1:] != key[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1]))] if len(key) else order
        found.append((key[once], lab[words.doc[once]], np.full(len(once), b), once))
    key, lab, batch, at = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
    first = order[starts]
    pos, neg = (np.add.reduceat((lab[order] == y).astype(float), starts) if len(key) else np.zeros(0) for y in (1, 0))
    spans = [batches[b].spans(batches[b].begin[i] - 1, batches[b].end[i])[0] for b, i in zip(batch[first].tolist(), at[first].tolist())]
    odds_pos, odds_neg = np.zeros(SIZE), np.zeros(SIZE)
    for k in range(0, len(spans), 8192):
        index, weight = subsequences(spans[k : k + 8192])
        odds_pos += np.bincount(index.ravel(), (weight * pos[k : k + 8192, None]).ravel(), SIZE)
        odds_neg += np.bincount(index.ravel(), (weight * neg[k : k + 8192, None]).ravel(), SIZE)
    n_pos, n_neg = (max(1, sum(int((lab == y).sum()) for lab in toxic)) for y in (1, 0))
    return np.log((odds_pos / n_pos + 0.01) / (odds_neg / n_neg + 0.01)).astype(np.float32)


def _best_by(group: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` highest scores of each group."""
    order = np.lexsort((-score, group))
    group = group[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return order[rank < most]


def _picked(batches: list[Words], toxic: list[np.ndarray], table: np.ndarray, usable: list[np.ndarray]) -> tuple[list, np.ndarray, list]:
    """The witnesses (the worst usable windows of each toxic document's three worst sentences) with their documents, and the clean documents'
    windows: hard ones, and others spread over all."""
    positive, owner, hard, spread, docs = [], [], [], [], 0
    for words, lab, own in zip(batches, toxic, usable):
        f = words.scores(table)[0]
        left, right, there = words.windows()
        row = np.arange(len(words.doc))
        isbad = lab[words.doc] == 1 if len(words.doc) else np.zeros(0, bool)
        mine = np.where(there & isbad & own, f, -np.inf)
        top = mine.argmax(axis=0) if len(row) else row
        score = mine[top, row]
        bad = row[score > -np.inf]
        one = bad[_best_by(words.sentence[bad], score[bad], 1)]
        for i in one[_best_by(words.doc[one], score[one], 3)]:
            spans = words.spans(left[top[i], i], right[top[i], i])
            positive.append(max(spans, key=lambda s: float((table[(x := subsequences([s]))[0]] * x[1]).sum())) if len(spans) > 1 else spans[0])
            owner.append(docs + int(words.doc[i]))
        other = np.where(there & ~isbad, f, -np.inf)
        top = other.argmax(axis=0) if len(row) else row
        good = row[~isbad]
        for i in good[_best_by(words.doc[good], other[top, row][good], 2)]:
            hard.append((float(other[top[i], i]), words.spans(left[top[i], i], right[top[i], i])[0]))
        for j, i in enumerate(good[:: max(1, len(good) * len(batches) // 6000)]):
            k = j % WORDS if there[j % WORDS, i] else 0
            spread.append(words.spans(left[k, i], right[k, i])[0])
        docs += words.texts
    hard = [s for _, s in sorted(hard, key=lambda x: -x[0])[:4000]]
    unique = {s.tobytes(): s for s in hard + spread}
    return positive, np.array(owner), list(unique.values())


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys. By sorting, since hash tables of so many keys are slow."""
    keys = np.sort(keys, axis=None)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted ones."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(keys.shape, bool)


def _usable(batches: list[Words], toxic: list[np.ndarray]) -> list[np.ndarray]:
    """Windows that may be witnesses: no clean document holds them, and several words are in two toxic documents at least. A toxic document
    without such a word may give any of its words."""
    keys = [words.keys() for words in batches]
    clean, toxic_keys, docs = [], [], []
    for b, (words, lab, k) in enumerate(zip(batches, toxic, keys)):
        there, bad = words.windows()[2], lab[words.doc] == 1
        clean.append(_distinct(k[there & ~bad]))
        own = there & bad
        toxic_keys.append(k[own])
        docs.append(np.broadcast_to(words.doc, own.shape)[own].astype(np.int64) + (b << 20))
    known = _distinct(np.concatenate(clean))
    key, doc = np.concatenate(toxic_keys), np.concatenate(docs)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
    key = key[first]
    twice = _distinct(key[1:][key[1:] == key[:-1]])
    out = []
    for words, k in zip(batches, keys):
        own = ~_among(k, known)
        own[1:] &= _among(k[1:], twice)
        none = np.bincount(words.doc, own.any(axis=0), words.texts) == 0
        own[0] |= none[words.doc]
        out.append(own)
    return out


def machine(batches: list[Words], toxic: list[np.ndarray], landmarks: int, rounds: int, cost: float) -> tuple[np.ndarray, float]:
    """Witnesses and SVM by turns; the table of the last machine, and its bias."""
    table, bias = _first_table(batches, toxic), 0.0
    usable = _usable(batches, toxic)
    for _ in range(rounds):
        positive, owner, negative = _picked(batches, toxic, table, usable)
        if not positive or not negative:
            break
        unique: dict[bytes, tuple[np.ndarray, set]] = {}
        for s, o in zip(positive, owner.tolist()):
            unique.setdefault(s.tobytes(), (s, set()))[1].add(o)
        spans = [s for s, _ in unique.values()]
        owners = [o for _, o in unique.values()]
        # a witness stays if it is that of two documents, or like another document's and unlike all clean windows
        alike, hit = kernel(spans, spans) >= 0.5, np.concatenate([kernel(spans, negative[k : k + 1024]).max(axis=1, keepdims=True) for k in range(0, len(negative), 1024)], axis=1).max(axis=1) >= 0.5
        stay = [len(o) > 1 or (not bad and len(set().union(*(owners[j] for j in np.flatnonzero(near)))) > 1) for o, bad, near in zip(owners, hit, alike)]
        chosen = [s for s, ok in zip(spans, stay) if ok] or spans
        table, bias = _fit(chosen + disguised(chosen, 1), negative + disguised(negative[:4000], 2), landmarks, cost)
    return table, bias


def document_stats(words: Words, scores: np.ndarray) -> np.ndarray:
    """Per text, from its windows' scores: those of its three worst sentences and of its second worst word, how much lies above -1/2, and its number of words."""
    out = np.tile([LOW, LOW, LOW, LOW, 0.0, 0.0], (words.texts, 1))
    if not len(words.doc):
        return out
    best = np.maximum(scores.max(axis=0), LOW)
    starts = np.flatnonzero(np.append(True, (words.sentence[1:] != words.sentence[:-1]) | (words.doc[1:] != words.doc[:-1])))
    worst, owner = np.maximum.reduceat(best, starts), words.doc[starts]
    order = np.lexsort((-worst, owner))
    first = np.flatnonzero(np.append(True, np.diff(owner[order]) > 0))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    for r in range(3):
        at = order[rank == r]
        out[owner[at], r] = worst[at]
    top = _best_by(words.doc, best, 2)
    second = top[np.append(False, words.doc[top][1:] == words.doc[top][:-1])]
    out[words.doc[second], 3] = best[second]
    out[:, 4] = np.log1p(np.bincount(words.doc, np.maximum(best + 0.5, 0), words.texts))
    out[:, 5] = np.log1p(np.bincount(words.doc, minlength=words.texts))
    return out


def _cut(texts: list[bytes]) -> list[list[int]]:
    """Places of the texts in portions of about BYTES."""
    out: list[list[int]] = [[]]
    held = 0
    for i, t in enumerate(texts):
        if held > BYTES:
            out.append([])
            held = 0
        out[-1].append(i)
        held += len(t)
    return out


def train(texts: list[bytes], labels: np.ndarray, landmarks: int = 256, rounds: int = 3, cost: float = 10.0) -> list[dict]:
    """Two machines, each of one half of the texts; how a document's score follows from a machine's is fitted on the half that it hasn't seen."""
    share = float(labels.mean()) if len(labels) else 0.0
    if min(labels.sum(), (1 - labels).sum()) < 8:
        return [{"table": np.zeros(SIZE, np.float32), "bias": 0.0, "doc": [0.0] * STATS + [float(np.log((share + 1e-3) / (1 - share + 1e-3)))]}]
    # each class is dealt evenly
    order = np.argsort(labels, kind="stable")
    halves = [np.sort(order[h::2]) for h in (0, 1)]
    models = []
    for fit, rest in (halves, halves[::-1]):
        own = [texts[i] for i in fit]
        table, bias = machine([Words([own[i] for i in p]) for p in _cut(own)], [labels[fit][p] for p in _cut(own)], landmarks, rounds, cost)
        other = [texts[i] for i in rest]
        stats = np.concatenate([document_stats(w := Words([other[i] for i in p]), w.scores(table)[0] + bias) for p in _cut(other)])
        models.append({"table": table, "bias": bias, "doc": logistic(stats, labels[rest], ridge=0.1).tolist()})
    return models


def train_toxicity(docs: DataFrame, labels: DataFrame, usable, max_rows: int = 8_000, max_chars: int = 20_000, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """The models, from at most max_rows labelled rows with usable true and texts of at most max_chars characters. With fewer than eight of a class, every score is the base rate."""
    sample = labelled_sample(docs, labels, label_col, usable, max_rows, max_chars, id_col, text_col)
    return train_in_one_task(sample, train) or train([], np.zeros(0))


def score_texts(texts: list[bytes], models: list[dict]) -> np.ndarray:
    """The mean of the models' scores."""
    out = np.zeros(len(texts))
    for p in _cut(texts) if texts else []:
        words = Words([texts[i] for i in p])
        scores = words.scores(*[m["table"] for m in models])
        stats = [document_stats(words, s + m["bias"]) for s, m in zip(scores, models)]
        out[p] = np.mean([sigmoid(np.c_[s, np.ones(len(p))] @ np.array(m["doc"])) for s, m in zip(stats, models)], axis=0)
    return out


def score_toxicity(docs: DataFrame, models: list[dict], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of docs plus score_col, from 0 to 1, of the whole text (null: as empty). A column of that name is replaced."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts([t.as_py() for t in texts], models), pa.float64())

    return docs.withColumn(score_col, score(text_bytes(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    models = train_toxicity(docs, labels, ~held_out("doc_id", 4, 2))
    scored = score_toxicity(docs, models)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

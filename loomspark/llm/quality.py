"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

A document is a sparse vector: its distinct words, hashed, share a weight of one; each structure statistic gives its
value and a one-hot bin. The score is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, the pairs in linear time as half of
|sum v_i x_i|^2 - sum |v_i x_i|^2, through a sigmoid.
"""

from __future__ import annotations

import operator
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomspark.llm.common import small_batches, text_bytes, trim
from loomspark.llm.learning import held_out, labelled_sample, sigmoid, train_in_one_task

WORDS = 1 << 16
BINS = 12
STATS = ["letters", "upper", "digits", "stops", "marks", "spaces", "word_length", "distinct", "repeats", "marked_words", "line_length", "lines", "length", "bare_words"]
SIZE = WORDS + len(STATS) * (BINS + 1)
_CLASS = np.zeros(256, np.uint8)  # 0: letters, also of other scripts
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _c in b".,;:'\"!?()-":
    _CLASS[_c] = 3
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 4
for _c in b" \t\n\x0b\x0c\r":
    _CLASS[_c] = 5
_MARKS = frozenset(b"#$%&*+/<=>@[\\]^_`{|}~!")


def statistics(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Each from 0 to 1, in the order of STATS."""
    n, size = len(words), max(1, len(text))
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6) if text else np.zeros(6)
    lines = text.count(b"\n") + 1
    letters = kinds[0] + kinds[1]
    repeats = sum(map(operator.eq, words, words[1:]))
    marked = sum(w[-1] in _MARKS for w in words)
    bare = sum(len(w) < 3 for w in words)
    m = max(1, n)
    return [
        letters / size, kinds[1] / max(1, letters), kinds[2] / size, kinds[3] / size, min(1, 4 * kinds[4] / size), kinds[5] / size,
        min(1, len(text) / m / 20), distinct / m, repeats / m, marked / m, min(1, size / lines / 1000), min(1, 10 * lines / m), min(1, np.log1p(n) / 12), bare / m,
    ]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the sparse vector."""
    words = text.split()
    own = set(words)
    stats = statistics(text, words, len(own))
    h = np.fromiter((zlib.crc32(w) & (WORDS - 1) for w in own), np.int64, len(own))
    at = WORDS + np.arange(len(STATS)) * (BINS + 1)
    bins = np.minimum((np.array(stats) * BINS).astype(np.int64), BINS - 1)
    index = np.concatenate([h, at, at + 1 + bins]).astype(np.int32)
    value = np.concatenate([np.full(len(own), len(own) ** -0.5 if own else 0.0), stats, np.full(len(STATS), 0.5)]).astype(np.float32)
    return index, value


def _stacked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [features(t) for t in texts]
    starts = np.cumsum([0, *(len(i) for i, _ in found[:-1])])
    return np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), starts


def raw_scores(model: dict, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and sum v_i x_i of each row."""
    linear = np.add.reduceat(model["w"][index] * value, starts)
    vx = model["v"][index] * value[:, None]
    total = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
    return model["w0"] + linear + 0.5 * ((total * total).sum(axis=1) - squares), total


def train(texts: list[bytes], labels: np.ndarray, rank: int = 8, epochs: int = 6, batch: int = 64, rate: float = 0.1, ridge: float = 1e-5) -> dict:
    """Adaptive-gradient descent on the logistic loss, both classes weighing alike. One class only: its base rate for all."""
    rng = np.random.default_rng(7)
    share = labels.mean() if len(labels) else 0.5
    prior = float(np.log((share * len(labels) + 1) / ((1 - share) * len(labels) + 1)))
    model = {"w0": prior if share in (0, 1) else 0.0, "w": np.zeros(SIZE), "v": rng.normal(0, 0.01, (SIZE, rank))}
    if share in (0, 1) or not len(labels):
        model["v"] *= 0
        return _packed(model)
    index, value, starts = _stacked(texts)
    ends = np.append(starts[1:], len(index))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    gw, gv, g0 = np.full(SIZE, 1e-6), np.full(SIZE, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            lengths = ends[rows] - starts[rows]
            begin = np.cumsum(np.append(0, lengths[:-1]))
            at = np.repeat(starts[rows] - begin, lengths) + np.arange(lengths.sum())
            i, x = index[at], value[at]
            raw, total = raw_scores(model, i, x, begin)
            err = (sigmoid(raw) - labels[rows]) * weight[rows]
            e = np.repeat(err, lengths)
            dw = e * x
            dv = e[:, None] * x[:, None] * (np.repeat(total, lengths, axis=0) - model["v"][i] * x[:, None])
            seen, inverse = np.unique(i, return_inverse=True)
            sw = np.bincount(inverse, dw) + ridge * model["w"][seen]
            sv = np.stack([np.bincount(inverse, dv[:, f]) for f in range(rank)], axis=1) + ridge * model["v"][seen]
            gw[seen] += sw**2
            gv[seen] += (sv**2).mean(axis=1)
            model["w"][seen] -= rate * sw / np.sqrt(gw[seen])
            model["v"][seen] -= 0.5 * rate * sv / np.sqrt(gv[seen])[:, None]
            g0 += err.sum() ** 2
            model["w0"] -= rate * err.sum() / np.sqrt(g0)
    return _packed(model)


def _packed(model: dict) -> dict:
    return {"w0": float(model["w0"]), "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}


def train_quality(docs: DataFrame, labels: DataFrame, usable, max_rows: int = 8_000, max_chars: int = 20_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model, from at most max_rows labelled rows with usable true and texts of at most max_chars characters. Without such rows every score is 0.5."""
    sample = labelled_sample(docs, labels, label_col, usable, max_rows, max_chars, id_col, text_col)
    return train_in_one_task(sample, train) or train([], np.zeros(0))


def score_quality(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of docs plus score_col, from 0 to 1, of the whole text (null: as empty). A column of that name is replaced."""

    small_batches(docs.sparkSession)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        out: list[np.ndarray] = [np.zeros(0)]
        for k in range(0, len(texts), 256):
            raw, _ = raw_scores(model, *_stacked([t.as_py() for t in texts[k : k + 256]]))
            out.append(sigmoid(raw))
        trim()
        return pa.array(np.concatenate(out), pa.float64())

    return docs.withColumn(score_col, score(text_bytes(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_quality(docs, labels, ~held_out("doc_id", 3, 1))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

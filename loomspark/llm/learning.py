"""What the trained operators share: a bounded labelled sample, one training task, a model that travels as bytes."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import give_back_memory, small_batches


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, max_rows: int, max_chars: int, id_col: str, text_col: str) -> DataFrame:
    """text and label of at most max_rows labelled rows, chosen by a hash of their ids, so alike on every run.

    usable is a condition on labels' columns. Texts beyond max_chars stay out, so that the sample has at most max_rows * max_chars characters. Labels
    other than 0 and 1, null ids and null texts aren't used; an id with both labels has 1, and of rows that repeat an id each counts.
    """
    chosen = labels.filter(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)  # the bound that makes the broadcast safe
    texts = docs.filter(F.length(text_col) <= max_chars).select(id_col, text_col)
    return texts.join(F.broadcast(chosen), id_col).select(F.col(text_col).cast("binary").alias("text"), F.col("__label").cast("int").alias("label"))


def train_in_one_task(sample: DataFrame, train: Callable[[list, np.ndarray], object]) -> object:
    """The model that train(texts, labels) makes, run once on an executor over the bounded sample."""

    def run(table: pa.Table) -> pa.Table:
        # sorted, so that the order in which rows arrive doesn't matter
        rows = sorted(zip(table.column("text").to_pylist(), table.column("label").to_pylist()))
        model = pickle.dumps(train([t for t, _ in rows], np.array([y for _, y in rows], float)), 5)
        del table, rows
        give_back_memory()
        return pa.table([pa.array([model], pa.binary())], ["model"])

    small_batches(sample.sparkSession)
    found = sample.groupBy(F.lit(0).alias("all")).applyInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else None


def held_out(id_col: str, parts: int, part: int) -> Column:
    """crc32 of the id as text has this remainder; a null id has not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

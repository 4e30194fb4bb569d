"""Pluggable folds: calculators with mergeable states, run over rows in any partitioning.

A fold makes a state of each key from batches of rows, merges states, and turns a whole one into its result. Every task folds the rows that it reads, whatever their keys; states
travel as bytes, meet in groups of at most FAN by rounds while a key has more, and only the last merge of a key makes results. So a hot key's rows are folded where they lie, and
no task holds more than FAN states of a key.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.sources.scratch import cutter

FAN = 64
MOST_KEYS = 10_000  # states that a task keeps before it passes them on


class Fold(Protocol):
    """add must be the same for any order of rows, and merge for any order and grouping of states, up to rounding."""

    columns: list[str]
    result_schema: str

    def zero(self) -> Any: ...
    def add(self, state: Any, rows: dict[str, np.ndarray]) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def result(self, state: Any) -> list[tuple]: ...


def run_fold(rows: DataFrame, key: str, fold: Fold, fan: int = FAN, cut: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """key, and the fold's result columns, of every key (a long) of rows; keys that are null are left out, and columns must not be null."""
    cut = cut or cutter(rows.sparkSession, "fold")
    names = fold.columns

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Any] = {}

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(states), pa.int64()), pa.array([pickle.dumps(s, 5) for s in states.values()], pa.binary())], ["key", "state"])
            states.clear()
            return out

        for b in batches:
            keys = b.column(0).to_numpy()
            order = np.argsort(keys, kind="stable")
            columns = [b.column(1 + k).to_numpy(zero_copy_only=False)[order] for k in range(len(names))]
            found, first = np.unique(keys[order], return_index=True)
            for k, lo, hi in zip(found.tolist(), first, [*first[1:], len(keys)]):
                states[k] = fold.add(states[k] if k in states else fold.zero(), dict(zip(names, (c[lo:hi] for c in columns))))
            if len(states) > MOST_KEYS:
                yield passed_on()
        if states:
            yield passed_on()

    def merged(table: pa.Table) -> Any:
        states = [pickle.loads(s.as_py()) for s in table.column("state")]
        whole = states[0]
        for s in states[1:]:
            whole = fold.merge(whole, s)
        return whole

    def halfway(table: pa.Table) -> pa.Table:
        return pa.table([table.column("key").slice(0, 1), pa.array([pickle.dumps(merged(table), 5)], pa.binary())], ["key", "state"])

    schema = StructType.fromDDL(f"key long, {fold.result_schema}")
    arrow_names = [f.name for f in schema.fields]

    def finished(table: pa.Table) -> pa.Table:
        k = table.column("key")[0].as_py()
        made = [(k, *r) for r in fold.result(merged(table))]
        return pa.table({n: list(c) for n, c in zip(arrow_names, zip(*made))} if made else {n: [] for n in arrow_names}).cast(target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    chosen = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), *names)
    states = cut(chosen.mapInArrow(partial, "key long, state binary"), "states-0")
    most = states.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for k in range(max(0, math.ceil(math.log(max(most, 1), fan)) - 1)):  # the tree's inner levels: one for each power of the fan
        groups = math.ceil(most / fan)
        most = groups
        spread = states.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
        states = cut(spread.groupBy("key", "part").applyInArrow(lambda t: halfway(t.select(["key", "state"])), "key long, state binary"), f"states-{k + 1}")
    return states.groupBy("key").applyInArrow(finished, schema).withColumnRenamed("key", key)


class FlowFold:
    """Attention to earlier positions, mean over heads, of cells (i, j, w): i, flow."""

    columns, result_schema = ["i", "j", "w"], "i long, flow double"

    def __init__(self, heads: int):
        self.heads = heads

    def zero(self) -> dict[int, float]:
        return {}

    def add(self, state: dict, rows: dict[str, np.ndarray]) -> dict:
        places, at = np.unique(rows["i"], return_inverse=True)
        sums = np.bincount(at, np.where(rows["j"] < rows["i"], rows["w"], 0.0))
        for i, x in zip(places.tolist(), sums.tolist()):
            state[i] = state.get(i, 0.0) + x
        return state

    def merge(self, a: dict, b: dict) -> dict:
        for i, x in b.items():
            a[i] = a.get(i, 0.0) + x
        return a

    def result(self, state: dict) -> list[tuple]:
        return [(i, x / self.heads) for i, x in sorted(state.items())]


class EntropyFold:
    """Entropy of the rows of cells (head, i, w) over n places, mean over rows and then heads, every cell with eps on top: entropy.

    A row's entropy needs its total, so the state keeps of each (head, i) the sum, the count and the sum of (w + eps) ln (w + eps), from which the rest follows.
    """

    columns, result_schema = ["head", "i", "w"], "entropy double"

    def __init__(self, n: int, eps: float = 1e-10):
        self.n, self.eps = n, eps

    def zero(self) -> dict[tuple, np.ndarray]:
        return {}

    def add(self, state: dict, rows: dict[str, np.ndarray]) -> dict:
        x = rows["w"] + self.eps
        keys, at = np.unique(np.stack([rows["head"], rows["i"]], 1).astype(np.int64), axis=0, return_inverse=True)
        at = at.ravel()
        sums = np.stack([np.bincount(at, x), np.bincount(at).astype(float), np.bincount(at, x * np.log(x))], 1)
        return self.merge(state, {tuple(k): s for k, s in zip(keys.tolist(), sums)})

    def merge(self, a: dict, b: dict) -> dict:
        for k, s in b.items():
            a[k] = a[k] + s if k in a else s
        return a

    def result(self, state: dict) -> list[tuple]:
        heads: dict[int, list[float]] = {}
        for (head, _), (total, count, xlogx) in state.items():
            rest = self.n - count  # cells that are absent
            total += rest * self.eps
            xlogx += rest * self.eps * math.log(self.eps)
            heads.setdefault(head, []).append(math.log(total) - xlogx / total)
        return [(sum(sum(h) / self.n for h in heads.values()) / len(heads),)] if heads else []

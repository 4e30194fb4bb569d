import math
import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import attention as A
from loomspark.operators import folds


@pytest.mark.parametrize("parts,fan", [(1, 64), (7, 2), (5, 64)])
def test_folds_equal_the_built_in_operators(spark, parts, fan):
    """In any partitioning, and with inner levels of the merge."""
    rng = random.Random(parts)
    cells = [(w, h, i, j, rng.random()) for w in range(3) for h in range(2) for i in range(6) for j in range(6) if rng.random() < 0.8]
    rows = spark.createDataFrame(cells, "window_idx long, head int, i int, j int, w double").repartition(parts).cache()
    flow = {(r.window_idx, r.i): r.flow for r in folds.run_fold(rows, "window_idx", folds.FlowFold(2), fan).collect()}
    own = {(r.window_idx, r.i): r.flow for r in A.flow(rows, 2).collect()}
    assert flow.keys() == own.keys() and all(math.isclose(flow[k], own[k], abs_tol=1e-12) for k in own)
    n = rows.select("window_idx").distinct().withColumn("n", F.lit(6))
    full = {(w, h, i) for w, h, i, _, _ in cells}
    assert len(full) == 36  # every row has a cell, so the mean over rows is over all of them
    entropy = {r.window_idx: r.entropy for r in folds.run_fold(rows, "window_idx", folds.EntropyFold(6), fan).collect()}
    expected = {r.window_idx: r.entropy for r in A.entropy(rows, n, ["window_idx"]).collect()}
    assert entropy.keys() == expected.keys() and all(math.isclose(entropy[k], expected[k], abs_tol=1e-9) for k in expected)


def longest():
    class Longest:
        """A fold of one's own: the longest word."""

        columns, result_schema = ["word"], "word string"

        def zero(self):
            return ""

        def add(self, state, rows):
            return max([state, *rows["word"]], key=lambda x: (len(x), x))

        def merge(self, a, b):
            return self.add(a, {"word": [b]})

        def result(self, state):
            return [(state,)]

    return Longest()  # a class of this function, so that it travels with its code


def test_a_fold_of_ones_own_with_a_hot_key_and_null_keys(spark):
    rows = [(1, f"w{k}") for k in range(500)] + [(2, "x"), (None, "lost"), (3, "")]
    df = spark.createDataFrame(rows, "k long, word string").repartition(9)
    assert sorted(map(tuple, folds.run_fold(df, "k", longest(), fan=3).collect())) == [(1, "w499"), (2, "x"), (3, "")]
    assert folds.run_fold(df.limit(0), "k", longest()).count() == 0

"""Small cases with known results: code isolation, code explained by text, null texts, table functions, ranks with history, concepts."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import models as M
from loomspark.operators import attention as A
from loomspark.operators import concepts as C
from loomspark.operators import segment as S
from loomspark.operators import tree as R


@pytest.mark.parametrize(
    "text,pieces",
    [
        ("Intro text.\n```python\nx = 1\n```\nmiddle \n\n$a + b$\nouter", ["Intro text.", "```python\nx = 1\n```", "middle \n\n$a + b$\nouter"]),
        ("para one\n\n  para two  \n\n\n\npara three", ["para one", "para two", "para three"]),
        ("lead\n    a = 1\n    b = 2\ntail\n\tc = 3", ["lead", "    a = 1\n    b = 2", "tail", "\tc = 3"]),
        ("```only```", ["```only```"]),
        ("   \n  ", []),
        ("a\n```\nx\n```\n```\ny\n```\nb", ["a", "```\nx\n```", "```\ny\n```", "b"]),
        ("a\u0001xb", ["a\u0001xb"]),
        ("```p```\u0001c q\u0001t", ["```p```", "\u0001c q\u0001t"]),
        (None, None),
    ],
)
def test_code_isolation_keeps_all_text(spark, text, pieces):
    got = spark.createDataFrame([(text,)], "text string").select(S.isolate_code(F.col("text")).alias("p")).first().p
    assert got == pieces


def test_text_beside_code_explains_it(spark):
    rows = [(1, "a", False, False), (1, "b", True, False), (1, "c", False, True), (1, "d", False, False), (1, "e", True, False), (1, "f", True, True), (2, "a", True, False)]
    segments = spark.createDataFrame([(d, s, "0", 0, k, code, math) for k, (d, s, code, math) in enumerate(rows)], "doc_id int, seg_id string, parent_id string, rule_idx int, start_pos int, has_code boolean, has_math boolean")
    got = {(r.src, r.dst, r.weight) for r in R.explains_edges(segments).collect()}
    assert got == {("a", "b", 0.9), ("d", "b", 0.7), ("d", "e", 0.9)}


def test_pairs_with_null_texts_are_unknown(spark):
    pairs = spark.createDataFrame([("abc", "a"), (None, "a"), ("a", None), (None, None)], "a_text string, b_text string")
    seen = M.classify_pairs(pairs, lambda a, b: ["explains"] * len(a)).collect()
    assert [r.relation for r in seen] == ["explains", "unknown", "unknown", "unknown"]


def test_table_functions(spark):
    M.table_function(spark, "halves", lambda t: t.split("|"))
    M.partition_function(spark, "numbered", lambda t: t.split("|"), "id", "at", "text")
    rows = spark.createDataFrame([(1, 0, "a|b"), (1, 1, None), (1, 2, "c"), (2, 0, ""), (3, 5, "d|e")], "id long, at long, text string").repartition(3)
    rows.createOrReplaceTempView("halved")
    lateral = {(r.id, r["at"], r.ord, r.content) for r in spark.sql("SELECT h.id, h.at, x.ord, x.content FROM halved h, LATERAL halves(h.text) x").collect()}
    column = {(r.id, r["at"], r.ord, r.content) for r in rows.select("id", "at", F.posexplode(F.split("text", r"\|", -1)).alias("ord", "content")).collect()}
    assert lateral == column
    got = sorted(map(tuple, spark.sql("SELECT * FROM numbered(TABLE(halved) PARTITION BY id ORDER BY at)").collect()))
    assert got == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 2, 2, "c"), (2, 0, 0, ""), (3, 5, 0, "d"), (3, 5, 1, "e")]


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_ranks_follow_their_history(spark, chunk):
    spectra = [[4.0, 3.0, 2.0, 1.0], [10.0, 0.0, 0.0, 0.0], [1.0, 1.0, 1.0, 1.0], [], [5.0, 1.0, 1.0, 1.0]]
    expected, history = [], []
    for s in spectra:
        target = round(sum(history) / len(history), 9) if history else 0.5
        total, run, rank = round(sum(s), 9), 0.0, 1
        for x in s:
            run += x
            if run >= total * (1 - target):
                break
            rank += 1
        rank = max(1, min(3, rank))
        history.append(rank / 4)
        expected.append((rank, target, round(sum(history) / len(history), 9)))
    rows = spark.createDataFrame([(h, k, 4, s) for h in (0, 7) for k, s in enumerate(spectra)], "head long, win long, n int, s array<double>")
    got = sorted(map(tuple, A.adaptive_rank_history(rows, 1, 3, chunk=chunk).collect()))
    assert got == [(h, k, *e) for h in (0, 7) for k, e in enumerate(expected)]
    assert A.adaptive_rank_history(rows.limit(0), 1, 3).count() == 0


def test_concepts(spark):
    turns = [(1, 0, "kernel idea alpha"), (1, 1, "kernel"), (1, 2, None), (1, 4, "kernel other words here now"), (1, 9, "Kernel ends"), (1, 3, "def x():\n import bypass bypass"), (2, 0, "kernel")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    threads = {(r.conv_id, r.concept, r.thread): (r["first"], r["last"], r.mentions, r.changed) for r in C.evolution(rows).collect()}
    assert threads[1, "kernel", 0] == (0, 1, 2, False) and threads[1, "kernel", 1] == (4, 4, 1, False) and threads[1, "kernel", 2] == (9, 9, 1, False)
    assert {(r.conv_id, r.concept): (r.kind, r.mentions, r.with_code, r.conversations) for r in C.research(rows).collect()} == {
        (1, "kernel"): ("definitive", 4, 0, 2), (1, "import"): ("early", 1, 1, 1), (1, "bypass"): ("early", 1, 1, 1), (2, "kernel"): ("early", 1, 0, 2)
    }
    assert C.evolution(rows, gap=5, alike=0.3).filter("concept = 'kernel' AND conv_id = 1").select("changed").collect() == [(True,)]
    assert C.evolution(rows.limit(0)).count() == 0 and C.research(rows.limit(0)).count() == 0


def test_ranks_of_sparse_and_hot_keys(spark):
    from loomspark.operators.skew import ranked_rows

    rows = [(k * 10**14, k % 3) for k in range(300)] + [(7, k) for k in range(400)]
    placed = ranked_rows(spark.createDataFrame(rows, "a long, b long"), ["a", "b"], "at", part_rows=50).collect()
    assert [(r.a, r.b) for r in sorted(placed, key=lambda r: r["at"])] == sorted(rows) and sorted(r["at"] for r in placed) == list(range(700))
    assert ranked_rows(spark.createDataFrame([], "a long"), ["a"], "at").count() == 0

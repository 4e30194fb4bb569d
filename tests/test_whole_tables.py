"""Queries that once read a part of their table: the rows of the SQL without its filter, or of brute force."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
import compare  # noqa: E402

from loomspark.functions.text import BREAK  # noqa: E402
from loomspark.plans import catalogue  # noqa: E402


def same(spark, d, name, sql):
    con = duckdb.connect()
    for t in ("embeddings", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    df = catalogue.queries()[name](spark, d)
    assert sorted(df.columns) == sorted(cols)
    want = compare.canon(cur.fetchall(), cols)
    assert compare.canon([tuple(compare._plain(x) for x in r) for r in df.collect()], df.columns) == want and want


@pytest.mark.parametrize("name", ["att_views_grouping_sets", "src_listed_pieces", "src_fetch_rows", "vec_segment_pool", "att_constrained", "ana_simplices"])
def test_whole_table(spark, sf_dir, name):
    same(spark, sf_dir, name, catalogue.oracle_sql()[name])


def test_all_transcripts(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(600))
    rows = [(1, 0, "user", long), (2, 0, "user", "short"), (3, 0, "user", "a"), (3, 1, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    q = catalogue.queries()
    got = {(r.doc_id, r.win_idx): r.text for r in q["win_context"](spark, str(tmp_path)).collect()}
    ws = f"user: {long}".split()  # 601 words: windows of 200 that overlap by 30
    assert got == {(1, k): " ".join(ws[s : s + 200]) for k, s in enumerate(range(0, 601, 170))} | {(2, 0): "user: short", (3, 0): f"user: a{BREAK}assistant: b"}
    seeds = {r.doc_id: r.text for r in q["seed_rules"](spark, str(tmp_path)).collect()}
    assert set(seeds) == {1, 2, 3} and "user: short" in seeds[2] and all("<processing_rules>" in x for x in seeds.values())

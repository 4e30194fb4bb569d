"""Queries over empty tables, and over tables with null rows and repeated rows: none fails, and where SQL says what empty tables give, that is given."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomspark.plans import catalogue

# at least one of each operator module, and all that run Python
NAMES = [
    "tree_stats", "tree_preorder_edges", "vec_pairs_gt_030", "vec_topk_neighbors", "vec_segment_pool", "vec_dual", "ana_pagerank20", "ana_wcc", "ana_clustering_coeff", "ana_node_patterns",
    "att_low_rank_svd", "att_blockwise", "att_constrained_low_rank", "att_greedy_segments", "seg_semantic_pieces", "seg_by_attention", "win_context", "win_token_sliding", "tok_interval_map",
    "tok_positions", "dedup_ratio", "dedup_code", "seed_hash_sample", "doc_guided", "doc_graph_summary", "doc_reconstruction", "graph_relations", "het_batch_edges", "het_cached_fetch", "ev_session",
]


def tables(sf_dir, root, change):
    for name in os.listdir(sf_dir):
        pq.write_table(change(pq.read_table(f"{sf_dir}/{name}")), f"{root}/{name}")
    return str(root)


@pytest.fixture(scope="module")
def empty_dir(sf_dir, tmp_path_factory):
    return tables(sf_dir, tmp_path_factory.mktemp("empty"), lambda t: t.slice(0, 0))


@pytest.fixture(scope="module")
def odd_dir(sf_dir, tmp_path_factory):
    nulls = lambda t: pa.table({n: pa.nulls(2, t.schema.field(n).type) for n in t.column_names}, schema=t.schema)
    return tables(sf_dir, tmp_path_factory.mktemp("odd"), lambda t: pa.concat_tables([t, t.slice(0, 3), nulls(t)]))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    assert catalogue.queries()[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", ["ana_density", "ana_tag_shares", "att_summary", "het_cache_report"])
def test_summaries_of_empty_tables(spark, empty_dir, name):
    """Shares and rates of nothing are null or a stated value, as in the SQL, not an error."""
    con = duckdb.connect()
    for table in os.listdir(empty_dir):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{empty_dir}/{table}')")
    found = con.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    got = catalogue.queries()[name](spark, empty_dir).select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall())) and got


@pytest.mark.parametrize("name", NAMES)
def test_null_and_repeated_rows(spark, odd_dir, name):
    assert catalogue.queries()[name](spark, odd_dir).count() > 0

import corpus_pipeline as C
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after each stage."""
    root = tmp_path_factory.mktemp("stages")
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, f in C.STAGES:
        f(spark, frames[-1], SF).write.parquet(f"{root}/{name}")
        frames.append(spark.read.parquet(f"{root}/{name}"))
    return [x.toPandas() for x in frames]


def test_columns(stages):
    for before, x in zip(stages, stages[1:-1]):
        assert list(x.columns) == C.COLUMNS and len(x)


def test_quality_keeps_good_documents(stages):
    import pandas as pd

    labels = pd.read_parquet(f"{SF}/labels.parquet")
    kept = set(stages[1].doc_id)
    good = labels[labels.quality == 1].doc_id
    assert good.isin(kept).mean() > 0.97 and labels[labels.quality == 0].doc_id.isin(kept).mean() < 0.2


def test_line_dedup_is_brute_force(stages):
    from test_line_dedup import brute

    rows = [(r.doc_id, r.text) for r in stages[1].itertuples()]
    assert sorted((r[0], r[3]) for r in brute(rows)) == sorted((r.doc_id, r.text) for r in stages[2].itertuples())


def test_one_of_each_component(stages):
    from test_near_dedup import brute

    rows = [(r.doc_id, r.text) for r in stages[2].itertuples()]
    assert sorted(c for i, _, c in brute(rows) if i == c) == sorted(stages[3].doc_id)


def test_mix_meets_its_targets(stages):
    from test_topk_mixing_media import brute_mix

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in stages[3].itertuples()]
    _, target = brute_mix(rows)
    words = stages[4].assign(n=stages[4].text.str.split().str.len()).groupby("source").n.sum()
    assert all(abs(words.get(s, 0) - t) <= max(4, 0.02 * t) for s, t in target.items())


def test_packing_holds_all(stages):
    pieces = stages[5]
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()
    assert set(pieces.doc_id) == set(stages[4].doc_id)


def test_run_gives_the_same(spark, stages):
    got = C.run(spark, SF).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[key].itertuples(index=False, name=None)) == sorted(stages[5][key].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory, hard_docs):
    """labels for the hard documents: nothing that can be learnt, so that quality keeps all of them."""
    root = tmp_path_factory.mktemp("small")
    spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages_of_hard_documents(spark, docs, hard_docs, small_dir):
    """Nulls, empty and very long texts, repeats and ties, with extra columns that the operators use themselves."""
    from test_line_dedup import brute as lines
    from test_near_dedup import brute as components

    extra = docs.selectExpr("*", "1 AS score", "2 AS n_lines", "3 AS n_dropped", "4 AS kept", "5 AS component_id", "6 AS slot", "7 AS size", "8 AS uid", "9 AS piece", "10 AS length", "11 AS node")
    kept = C.quality(spark, extra, small_dir)
    assert kept.columns == C.COLUMNS and kept.count() == len(hard_docs)
    out = C.dedup_lines(spark, extra, small_dir).collect()
    known = [r for r in hard_docs if r[0] is not None and [x[0] for x in hard_docs].count(r[0]) == 1]
    want = {r[0]: r[3] for r in lines([(r[0], r[1]) for r in known])}
    assert len(out) == len(hard_docs) and all(r.text == want[r.doc_id] and r.n_chars == len(r.text) for r in out if r.doc_id in want)
    out = C.dedup_documents(spark, extra, small_dir).collect()
    alone = {c for i, _, c in components(hard_docs) if (-(2**63) if i is None else i) == c}
    assert {-(2**63) if r.doc_id is None else r.doc_id for r in out} == alone
    out = C.mixing(spark, extra, small_dir).collect()
    words = lambda t: len((t or "").split())
    size = {}
    for r in hard_docs:
        size[r[0]] = size.get(r[0], 0) + words(r[1])
    taken = {}
    for r in out:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + words(r.text)
        assert words(r.text) and r.n_chars == len(r.text)
    assert all(n <= 3 * size[i] for i, n in taken.items())
    out = C.packing(spark, extra, small_dir).collect()
    assert {r.doc_id for r in out} == {r[0] for r in hard_docs} and sum(r.piece == 0 for r in out) == len(hard_docs)


def test_stages_of_an_empty_table(spark, no_docs, small_dir):
    for name, stage in C.STAGES:
        out = stage(spark, no_docs, small_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == C.COLUMNS)

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomspark.llm import packing as P
from loomspark.llm import token_output as O
from loomspark.llm.common import Scratch
from loomspark.llm.tokens import codec, vocabulary

KINDS = [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")]


def expected(name, text):
    return Tokenizer.from_file(vocabulary(name)).encode(text, add_special_tokens=False).ids


_T = {name: Tokenizer.from_file(vocabulary(name)) for name, _ in KINDS}


@pytest.mark.parametrize("name,kind", KINDS)
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from(list("aAbzé ÉßΣσ́ .,'!?19²\n\t   <|endoftext>")), max_size=40))
def test_ids_are_the_whole_texts(name, kind, text):
    got = np.frombuffer(codec(vocabulary(name), kind).ids(text.encode()), "<u4").tolist()
    assert got == _T[name].encode(text, add_special_tokens=False).ids


def test_round_trip_of_the_file_format(spark, docs, hard_docs):
    path = f"{Scratch(spark, 'test').root}/ids"
    O.write_tokens(docs, path, vocabulary(KINDS[0][0]), "words", end_id=2)
    rows = O.with_starts(O.read_tokens(spark, path)).collect()
    by_start = sorted(rows, key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in by_start]
    assert ids == sorted(ids) and len(ids) == len(hard_docs)
    at = 0
    for r in by_start:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    texts = {}
    for r in hard_docs:
        texts.setdefault(r[0], []).append(expected(KINDS[0][0], r[1] or "") + [2])
    for r in by_start:
        assert list(r.ids) in texts[r.doc_id]


def test_crc_and_empty(spark, no_docs):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 70000],), ([],)], "ids array<int>").select(O.ids_crc32(F.col("ids")).alias("c"))
    assert sorted(r.c for r in df.collect()) == sorted([zlib.crc32(np.array([1, 70000], "<u4").tobytes()), 0])
    path = f"{Scratch(spark, 'test').root}/ids"
    O.write_tokens(no_docs, path, vocabulary(KINDS[0][0]), "words", end_id=2)
    assert O.with_starts(O.read_tokens(spark, path)).count() == 0


def test_the_file_format(spark, tmp_path):
    """Dictionary or delta encoding, bounded row groups, page indexes; and chosen ids read a few pages only."""
    import glob

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(k, " ".join(f"word{(k * j) % 991}" for j in range(60))) for k in range(3000)], "doc_id long, text string").coalesce(1)
    path = f"file://{tmp_path}/ids"
    O.write_tokens(docs.withColumns({"part": docs.doc_id, "row": docs.doc_id, "ids": docs.text}), path, vocabulary(KINDS[0][0]), "words", end_id=2, row_group_bytes=50_000, page_rows=100)
    groups = rows = 0
    for f in glob.glob(f"{tmp_path}/ids/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        rows += meta.num_rows
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert set(columns) == {"part", "row", "doc_id", "n_tokens", "ids.list.element"}
            for c in columns.values():
                assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(c.encodings) and c.has_offset_index and c.compression == "ZSTD"
            assert all(columns[c].has_column_index for c in ("part", "row", "doc_id", "n_tokens"))
    assert rows == 3000 and groups > 4
    found = O.read_documents(spark, path, [5, 2900])
    assert sorted(r.doc_id for r in found.collect()) == [5, 2900]
    scanned = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().get("numOutputRows").get().value()
    assert scanned <= 400  # two pages, of which groups may share rows
    whole = O.read_tokens(spark, path).select("n_tokens")
    assert "ids" not in whole._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_best_fit_is_exact_on_small_cases():
    bins, offsets = P.best_fit([6, 5, 5, 4], 10)
    assert len(set(bins)) == 2 and sorted(zip(bins, offsets)) == sorted(set(zip(bins, offsets)))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_bins_hold(lengths):
    bins, offsets = P.best_fit(lengths, 50)
    held = {}
    for n, b, o in zip(lengths, bins, offsets):
        held.setdefault(b, []).append((o, n))
    for items in held.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 50


@pytest.mark.parametrize("group_rows", [50_000, 40])
def test_packing_places_every_piece(spark, docs, hard_docs, group_rows):
    many = docs
    for k in range(1, 12):
        many = many.unionByName(docs.withColumn("doc_id", docs.doc_id + 1000 * k))
    pieces = P.token_pieces(many, vocabulary(KINDS[1][0]), "bytes", 0, capacity=256)
    rows = P.pack_pieces(pieces, 256, group_rows=group_rows, fan_in=2, carry=8).collect()
    assert len(rows) == pieces.count()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == 256 or r.piece == 0
    for items in held.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 256
    ids = expected(KINDS[1][0], hard_docs[0][1]) + [0]
    assert any(r.doc_id == 1 and r.start == 0 and r.ids_crc32 == zlib.crc32(np.array(ids[: r.length], "<u4").tobytes()) for r in rows)
    least = -(-sum(r.length for r in rows) // 256)
    assert len(held) <= least * (1.15 if group_rows == 40 else 1.05) + 1


def test_packing_through_the_tree():
    """Twelve groups, packed and merged as the rounds do: next to no sequence more than the lengths need."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    lengths = np.minimum(2047, rng.lognormal(6, 1, 60_000).astype(int) + 1)
    groups = [pa.table({"bin": pa.array(part), "length": pa.array(lengths[part]), "offset": pa.array(np.zeros(len(part), np.int64)), "done": pa.array(np.zeros(len(part), bool))}) for part in np.array_split(np.arange(len(lengths)), 12)]
    final = 0
    while groups:
        last = len(groups) == 1
        packed = [P._round(2048, 512, 2037, last)(g) for g in groups]
        final += sum(len(set(t.filter(t["done"])["bin"].to_pylist())) for t in packed)
        rest = [t.filter(pa.array([not x for x in t["done"].to_pylist()])) for t in packed]
        groups = [] if last else [pa.concat_tables(rest[i::2]) for i in range(2)] if len(groups) > 2 else [pa.concat_tables(rest)]
    assert final <= -(-lengths.sum() // 2048) * 1.002 + 1


def test_packing_with_clashing_columns(spark):
    pieces = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (3, 10, "c")], "doc_id long, length long, extra string").selectExpr("*", "9 AS uid", "9 AS bin", "9 AS grp", "true AS done", "'x' AS sequence_id", "1.5 AS offset")
    rows = P.pack_pieces(pieces, 10).collect()
    assert {(r.doc_id, r.extra) for r in rows} == {(1, "a"), (2, "b"), (3, "c")} and len({r.sequence_id for r in rows}) == 3 and {r.offset for r in rows} == {0}


def test_packing_empty_and_wrong(spark, no_docs):
    pieces = P.token_pieces(no_docs, vocabulary(KINDS[1][0]), "bytes", 0)
    assert P.pack_pieces(pieces).count() == 0
    with pytest.raises(ValueError):
        P.pack_pieces(spark.createDataFrame([(1, 3000)], "doc_id long, length long"))

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.operators import segment as S
from loomspark.operators import text_attention as TA

SCHEMA = "doc_id long, text string"


def brute_cells(words, bands, radii):
    """All pairs of places, in each layer and head."""
    n, out = len(words), {}
    for layer, band in enumerate(bands):
        for head, r in enumerate(radii):
            for i in range(n):
                scores = {}
                for j in range(max(0, i - band), i):
                    same = sum(0 <= j + d and 0 <= i + d < n and words[i + d] == words[j + d] for d in range(-r, r + 1))
                    if same:
                        scores[j] = same / (2 * r + 1)
                for j, s in scores.items():
                    out[layer, head, i, j] = s / (1 + sum(scores.values()))
    return out


@pytest.mark.parametrize("bands,radii", [((16, 64), (0, 1)), ((3,), (2,)), ((5, 7, 2), (0,))])
def test_cells_are_those_of_all_pairs(spark, bands, radii):
    rng = random.Random(len(bands))
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 2, 30, 90)]
    docs = spark.createDataFrame([*enumerate(texts), (9, None), (10, " \n ")], SCHEMA)
    tokens = TA.tokens_of(docs)
    got = defaultdict(dict)
    for r in TA.banded_attention(tokens, bands, radii).collect():
        got[r.doc_id][r.layer, r["head"], r.i, r.j] = r.w
    for k, text in enumerate(texts):
        expected = brute_cells(text.split(), bands, radii)
        assert got[k].keys() == expected.keys()
        assert all(abs(got[k][x] - w) < 1e-12 for x, w in expected.items())
    assert not got[9] and not got[10]


def test_tokens_have_their_places(spark):
    text = "Änd  then\n\nthe\tEnd x "
    rows = TA.tokens_of(spark.createDataFrame([(1, text)], SCHEMA)).orderBy("tok_idx").collect()
    assert [text[r.begin : r.end].lower() for r in rows] == [r.word for r in rows] == ["änd", "then", "the", "end", "x"]
    assert [r.tok_idx for r in rows] == list(range(5))


def test_a_hot_word_costs_the_band(spark):
    """3000 equal words with a band of 8: at most 8 cells a word."""
    docs = spark.createDataFrame([(1, "x " * 3000)], SCHEMA)
    assert TA.banded_attention(TA.tokens_of(docs), (8,), (0,)).count() == 3000 * 8 - 36


def test_attention_decides_where_texts_are_cut(spark):
    """Two topics, each of repeated words: what is cut changes with the cells, and only at boundaries."""
    text = " ".join(["red green blue"] * 12 + [f"w{k}" for k in range(6)] + ["one two three"] * 12)
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "short")], SCHEMA)
    tokens = TA.tokens_of(docs)
    flows = TA.text_flow(TA.banded_attention(tokens), tokens)
    assert flows.filter("doc_id = 1").count() == 78
    found = {r.position for r in TA.text_boundaries(flows).filter("doc_id = 1").collect()}
    assert 36 in found  # the first new word
    pieces = TA.segment_by_attention(docs).orderBy("doc_id", "ord").collect()
    starts = {r.start_pos for r in pieces if r.doc_id == 1} - {0}
    begin = {r.tok_idx: r.begin for r in tokens.filter("doc_id = 1").collect()}
    assert starts == {begin[p] for p in found if p}
    assert [(r.doc_id, r.content) for r in pieces if r.doc_id > 1] == [(2, ""), (4, "short")]
    none = TA.segment_by_attention(docs, attn=TA.banded_attention(tokens).limit(0))
    assert none.filter("doc_id = 1").count() == 1


def test_dual_attention_links_pieces_about_the_same(spark):
    a, b = "alpha beta gamma delta " * 4, "one two three four " * 4
    docs = spark.createDataFrame([(1, f"{a}\n\n{b}\n\n{a}\n\n{b}"), (2, "lone"), (3, None), (4, "")], SCHEMA)
    wide = TA.banded_attention(TA.tokens_of(docs), (16, 64), (0, 1))
    pieces, graph = TA.segment_with_dual_attention(docs, attn=wide)
    got = {(r.doc_id, r.ord): r for r in pieces.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}
    w = {(r.i, r.j): r.weight for r in graph.filter("doc_id = 1").collect()}
    assert min(w[2, 0], w[3, 1]) > 5 * w.get((1, 0), 0) and (0, 1) not in w  # a neighbour's equal words reach over an edge
    assert got[1, 1].start_pos == got[1, 0].end_pos + 1 and got[2, 0].links == []
    for n in [r.links for r in pieces.collect()]:
        assert all(isinstance(x, int) for x in n)
    swapped, _ = TA.segment_with_dual_attention(docs, refine=lambda p, g: p.filter("ord > 0"), attn=wide)
    assert swapped.count() == 3


def test_pooling_against_brute_force(spark):
    text = "a b a\n\nb a\n\na"
    docs = spark.createDataFrame([(1, text)], SCHEMA)
    tokens, pieces = TA.tokens_of(docs), TA.located_pieces(docs, S.paragraphs)
    cells = brute_cells(text.split(), (16, 64), (0, 1))
    seg = [0, 0, 0, 1, 1, 2]
    expected = defaultdict(float)
    for (layer, _, i, j), w in cells.items():
        expected[layer, seg[i], seg[j]] += w / (seg.count(seg[i]) * seg.count(seg[j]) * 2)
    got = {(r.layer, r.i, r.j): r.w for r in TA.node_attention(TA.banded_attention(tokens), tokens, pieces).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-12 for k, v in expected.items())


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert TA.segment_by_attention(none).count() == 0
    pieces, graph = TA.segment_with_dual_attention(none.withColumn("n", F.lit(1)))
    assert pieces.count() == 0 and graph.count() == 0

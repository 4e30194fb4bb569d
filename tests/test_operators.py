import os
import random
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import align, attention, dedup, graph, hetero, segment, synth, tree, vectors, windows
from loomspark.sources import tapes
from loomspark.sources.scratch import cutter

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("Intro.\n```py\nx\n```\nafter ", ["Intro.", "```py\nx\n```", "after"]),
        ("a\n\n b \n\n\n\nc", ["a", "b", "c"]),
        ("x\n    code\n    more\ny", ["x", "    code\n    more", "y"]),
        ("   ", []),
        ("```a```", ["```a```"]),
    ],
)
def test_isolate_code(spark, text, want):
    assert one(spark, text, segment.isolate_code) == want


@pytest.mark.parametrize("text,code,math", [("x;", True, False), ("def f", True, False), ("$a$", False, True), (r"\[a\]", False, True), ("\\frac{", True, False), ("\\\\frac{x", False, True), ("plain", False, False)])
def test_flags(spark, text, code, math):
    assert (one(spark, text, X.has_code), one(spark, text, X.has_math)) == (code, math)


def test_unicode_words(spark):
    assert one(spark, "été à l'Été", X.word_set) == ["été", "à", "l"]
    assert one(spark, "a b", X.words) == ["a", "b"]


def test_speaker_label_compat(spark):
    text = "Speaker A: hi\nB: yo"
    assert one(spark, text, segment.mark_speakers) == "<SPEAKER_BOUNDARY>Speaker A: </SPEAKER_BOUNDARY>hi<SPEAKER_BOUNDARY>\nB: </SPEAKER_BOUNDARY>yo"
    assert one(spark, text, lambda c: segment.mark_speakers(c, True)).count("Speaker A") == 2


def test_located_cursor(spark):
    rows = spark.createDataFrame([("ab ab cd", ["ab", "ab", "zz", "cd", " "])], "c string, p array<string>")
    got = rows.select(tree.located(F.col("c"), F.col("p")).alias("x")).first().x
    assert [(r.piece, r.at) for r in got] == [("ab", 0), ("ab", 3), ("cd", 6)]


def test_tree_slices_parents_and_rules(spark):
    docs = spark.createDataFrame([(1, "One. Two\n\nThree. Four\n\ndef f():\n  return 1\n"), (2, "flat"), (3, "")], "doc_id long, text string")
    halves = lambda c: F.split(c, r"\. ", -1)
    t = tree.build_tree(docs, [segment.paragraphs, halves], levels=3).toPandas()
    text = {1: "One. Two\n\nThree. Four\n\ndef f():\n  return 1\n"}
    for r in t[t.doc_id == 1].itertuples():
        assert text[1][r.start_pos : r.end_pos] == r.content
    both = t[(t.doc_id == 1) & (t.level == 1)]
    assert set(both.rule_idx) == {0, 1}  # two rules that both split give two sets of children
    first = tree.build_tree(docs, [segment.paragraphs, halves], levels=1, first_rule_wins=True).toPandas()
    assert set(first[first.level == 1].rule_idx) == {0}
    assert not t[t.atomic].empty and not t.parent_id.isin(t[t.atomic].seg_id).any()
    assert len(t[t.doc_id == 2]) == 1
    view = tree.children_view(tree.build_tree(docs, [segment.paragraphs, halves], levels=1)).toPandas()
    assert len(view) == 1 and view.children[0][0].startswith("0.1-")


def test_windows(spark):
    with pytest.raises(ValueError):
        windows.word_windows(F.lit("a"), 4)
    docs = spark.createDataFrame([(1, "word " * 900), (2, " "), (3, "a\n\n\n\nb")], "doc_id long, text string")
    got = windows.context_windows(docs, 1000).toPandas()
    assert len(got[got.doc_id == 1]) == 6 and got[got.doc_id == 2].text.tolist() == [" "] and got[got.doc_id == 3].text.tolist() == ["a\n\nb"]
    assert set(" ".join(got[got.doc_id == 1].text).split()) == {"word"}
    ab = spark.createDataFrame([(["a", "b", "c"], ["c", "d"])], "a array<string>, b array<string>")
    assert ab.select(windows.window_overlap(F.col("a"), F.col("b"), 10).alias("o")).first().o == 1


def test_graph_metrics(spark):
    cycle = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0)], "src long, dst long, weight double")
    nodes = spark.range(5)
    wcc = {r.id: r.comp for r in graph.connected_components(nodes, cycle, cutter(spark, "t")).collect()}
    assert wcc == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    one_graph = (nodes.withColumn("graph_id", F.lit(0).cast("long")), cycle.withColumn("graph_id", F.lit(0).cast("long")))
    pr = {r.id: r.importance for r in graph.pagerank(*one_graph).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-9 and pr[4] < pr[0] and abs(pr[0] - pr[2]) < 1e-9
    loop = {r.id: r.importance for r in graph.pagerank_shuffled(nodes, cycle, cutter(spark, "t"), iterations=8).collect()}
    fixed = {r.id: r.importance for r in graph.pagerank(*one_graph, iterations=8, tol=None).collect()}
    assert all(abs(loop[k] - fixed[k]) < 1e-9 for k in loop)
    assert graph.density(spark.range(0), cycle.limit(0)).first().density is None
    assert graph.sparsify(cycle.selectExpr("src AS i", "dst AS j", "weight AS w")).count() == 0


def test_simplices_limits(spark):
    full = lambda n: spark.createDataFrame([(i, j, 1.0) for i in range(n) for j in range(n) if i != j], "i int, j int, w double")
    count = lambda n: {r.dim: r["count"] for r in graph.simplices(full(n), n).groupBy("dim").count().collect()}
    assert count(3) == {0: 3, 1: 3} and count(4) == {0: 4, 1: 6, 2: 4} and count(5) == {0: 5, 1: 10, 2: 10, 3: 5}


def test_classify_priority(spark):
    rows = spark.createDataFrame([("TODO ```x```", True, False, 0.9), ("code", True, False, 0.0), ("low", False, False, 0.0), ("high", False, False, 0.9)], "content string, has_code boolean, has_math boolean, importance double").withColumn("doc_id", F.lit(1))
    assert [r.tag for r in graph.classify(rows).orderBy("content").collect()] == ["TRACK", "KEEP", "KEEP", "DELETE"]


def test_merge_is_anchored(spark):
    b = spark.createDataFrame([(0, p, 0.1 * p, "a" if p % 2 else "b") for p in (10, 14, 16, 30)], "g int, position int, strength double, type string")
    got = [(r.position, r.n) for r in attention.merge_near(b, ["g"]).orderBy("position").collect()]
    assert got == [(10, 2), (16, 1), (30, 1)]


def test_svd_and_entropy(spark):
    cells = spark.createDataFrame([(0, 0, 0, i, j, 1.0 / 4) for i in range(4) for j in range(4)], "window_idx long, layer int, head int, i int, j int, w double")
    low = attention.low_rank(cells, ratio=0.25).toPandas()
    assert (low["rank"] == 1).all() and abs(low.w - 0.25).max() < 1e-9
    assert (attention.low_rank(cells, ratio=0.1, by_mass=True).toPandas().w == 0).all()
    n = spark.createDataFrame([(0, 4)], "window_idx long, n long")
    e = attention.entropy(cells, n, ["window_idx", "layer"]).first().entropy
    assert abs(e - 1.3862943611) < 1e-8
    gap = attention.entropy(cells.filter("j < 2"), n, ["window_idx", "layer"]).first().entropy
    assert abs(gap - 0.6931471806) < 1e-6


def test_interval_map(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 9), (1, 2, 5000, 5003), (1, 3, 12, 12)], "doc_id long, tok_idx long, begin long, end long")
    segs = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 4, 20), (1, 2, 0, 0)], "doc_id long, seg_idx long, begin long, end long")
    got = {r.tok_idx: (r.seg_idx, r.n_segs) for r in align.interval_map(tokens, segs).collect()}
    assert got == {0: (0, 1), 1: (1, 2), 2: (0, 0), 3: (1, 1)}


def test_code_dedup(spark):
    rows = spark.createDataFrame([(1, 0, "```\nx = 1 # a\n```\nt\n"), (1, 1, "```py\nx = 1\n```\nmore\n"), (2, 0, "```\na\n```\n```\na\n```\n")], "doc_id long, ord int, content string")
    rows = rows.withColumns({"level": F.lit(1), "title": F.lit(""), "start_line": F.lit(0)})
    got = {(r.doc_id, r.ord): r.content for r in dedup.unique_code(rows).collect()}
    assert "x = 1" in got[1, 0] and "```" not in got[1, 1] and "more" in got[1, 1] and got[2, 0].count("```\na\n```") == 2


def guided_nodes(**columns):
    base = {"id": ["a", "b", "c"], "importance": [0.1, 0.9, 0.2], "segment_type": ["x"] * 3, "content": ["p", "q", "r"]}
    base |= columns
    return pd.DataFrame({**base, "formatted": base["content"], "opening": ["o"] * len(base["id"])})


def test_guided_order_against_brute_force():
    """Every step's choice, found anew by looking at all segments and all links."""
    r = random.Random(7)
    for n in (1, 2, 9, 25):
        ids = [f"n{k:02}" for k in range(n)]
        vocabulary = [f"w{k}" for k in range(30)]
        nodes = pd.DataFrame({"id": ids, "importance": [r.randrange(4) / 4 for _ in ids], "segment_type": [r.choice(["example", "foundational", "general"]) for _ in ids], "content": [" ".join(r.choices(vocabulary, k=r.randrange(80))) for _ in ids], "opening": "", "formatted": ""})
        nodes["formatted"] = nodes["content"]
        links = {i: r.choices(ids, k=r.randrange(4)) for i in ids}
        rows, seen, section, lines, tail = {x.id: x for x in nodes.itertuples()}, [], "introduction", 0, ["w1", "w2"]
        while len(seen) < n:
            near = [i for i in ids if i not in seen and any(i in links[j] for j in seen)]
            value = lambda i: 0.3 * rows[i].importance + 0.4 * sum(j in seen for j in links[i]) + 0.2 * (rows[i].segment_type == section) + (min(len(set(tail[-100:]) & set(rows[i].content.split()[:50])) / 10, 0.3) if seen else 0)  # noqa: B023, E731
            pick = min(near, key=lambda i: (-value(i), i)) if near else min((i for i in ids if i not in seen), key=lambda i: (-rows[i].importance, i))
            seen.append(pick)
            x = rows[pick]
            tail, lines = tail + x.content.split(), lines + 2
            if x.segment_type != section or lines >= 50:
                header = f"\n{synth.HEADERS.get(x.segment_type, synth.OTHER_HEADER)}\n"
                tail, section, lines = tail + header.lower().split(), x.segment_type, lines + header.count("\n")
        assert synth.guided_document(nodes, links, "w1 w2")[0] == seen


def test_guided_documents_visit_all():
    order, text = synth.guided_document(guided_nodes(), {"b": ["a"], "a": ["b"]})
    assert order == ["b", "a", "c"] and text.endswith("Document processing complete.\n")
    # the words of what has been written decide between equal neighbours, its openings and headers included
    nodes = guided_nodes(id=["a", "b", "c"], importance=[0.9, 0.1, 0.1], content=["start", "none", "further discussion start"])
    assert synth.guided_document(nodes, {"a": ["b", "c"]})[0] == ["a", "c", "b"]


def test_openings_and_formats(spark):
    rows = [("example", "e", "\nTo illustrate this concept:\n", "*Example:*\ne"), ("x", "However so", "\nHowever, it's important to note:\n", "However so"), ("contrast", "c", "\nHowever, it's important to note:\n", "c"), ("foundational", "One. two", "\nFurthermore:\n", "**One**\n\nOne. two"), ("foundational", "import x", "\nFurthermore:\n", "import x"), ("x", "A question", "\nThis raises an important question:\n", "A question")]
    df = spark.createDataFrame([r[:2] for r in rows], "k string, t string")
    got = df.select(synth.opening(F.col("k"), F.col("t")).alias("o"), synth.formatted(F.col("k"), F.col("t"), X.key_concept(F.col("t"))).alias("f")).collect()
    assert [(r.o, r.f) for r in got] == [r[2:] for r in rows]


def test_builders(spark, monkeypatch):
    segments = spark.createDataFrame([(1, "a", "x", 1.0, "KEEP", None, 0, False, False)], "doc_id long, id string, content string, importance double, tag string, segment_type string, start_pos int, has_code boolean, has_math boolean")
    edges = spark.createDataFrame([], "doc_id long, src string, dst string")
    assert synth.build_document(segments, edges, "linear").first().text == "x"
    assert synth.build_document(segments, edges, "unheard of").first().text.startswith("# Knowledge Synthesis")
    monkeypatch.setattr(synth, "STRATEGIES", dict(synth.STRATEGIES))
    synth.register_strategy("shout", lambda s: s.select("doc_id", F.upper("content").alias("text")))
    assert synth.reassemble(segments, "shout").first().text == "X"


def test_seeds_of_blank_texts(spark):
    docs = spark.createDataFrame([(1, "  "), (2, None), (3, ""), (4, "one. two")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in synth.seeded_at_random(docs).collect()}
    assert got[1] == "  " and got[2] is None and got[3] == "" and got[4].startswith("<processing_hints>")
    ruled = {r.doc_id: r.x for r in docs.select("doc_id", synth.seeded_with_rules(F.col("text"), {"segmentation": "cut"}).alias("x")).collect()}
    assert ruled[2] is None and ruled[3] == "" and "<segmentation_rule>cut<" in ruled[4] and "Group by theme" in ruled[4]


def test_greedy_segments_without_boundaries(spark):
    b = spark.createDataFrame([(1, 60, 0.5), (1, 70, 0.4)], "doc long, position long, strength double")
    groups = spark.createDataFrame([(1,), (2,)], "doc long")
    got = sorted((r.doc, r.ord, r.start, r.end, r.confidence) for r in attention.greedy_segments(b, ["doc"], 50, groups).collect())
    assert got == [(1, 0, 0, 60, 0.5), (1, 1, 60, -1, 0.8), (2, 0, 0, -1, 1.0)]


def test_pairs_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0, 2.0]), (1, None), (2, [1.0, 0.0, 2.0]), (3, [1.0, None, 2.0]), (4, [5.0, 5.0]), (5, [5.0, 5.0]), (None, [9.0, 9.0]), (6, [])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    for block in (4096, 1):
        assert sorted((r.src, r.dst, r.weight) for r in vectors.similar_pairs(df, 1.0, block).collect()) == [(0, 2, 5.0), (4, 5, 50.0)]
        near = sorted((r.src, r["rank"], r.dst) for r in vectors.nearest(df, 1, block).collect())
        assert near == [(0, 1, 2), (2, 1, 0), (4, 1, 5), (5, 1, 4)]


def test_nearest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(k, [1.0, float(k == 9)]) for k in range(12)], "id long, vec array<double>")
    for block in (4096, 3):
        got = sorted((r["rank"], r.dst) for r in vectors.nearest(df, 3, block).filter("src = 5").collect())
        assert got == [(1, 0), (2, 1), (3, 2)]


def brute_graph(n, p, seed):
    import random

    rng = random.Random(seed)
    return {(i, j) for i in range(n) for j in range(n) if rng.random() < p}


def test_clustering_and_cliques_against_brute_force(spark):
    import itertools

    cells = brute_graph(14, 0.4, 3)
    df = spark.createDataFrame([(i, j) for i, j in cells], "i long, j long")
    want = {}
    for v in range(14):
        near = [j for i, j in cells if i == v]
        if len(near) >= 2:
            want[v] = sum((x, y) in cells for x in near for y in near if x != y) / (len(near) * (len(near) - 1))
    got = {r.id: r.coefficient for r in graph.clustering(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    links = {tuple(sorted(c)) for c in cells if c[0] != c[1]}
    edges = spark.createDataFrame(sorted(links) + [(3, 1), (2, 2)], "src long, dst long")
    links |= {(1, 3)}
    whole = lambda k: sorted(c for c in itertools.combinations(range(14), k) if all(p in links for p in itertools.combinations(c, 2)))
    assert sorted(tuple(r) for r in graph.triangles(edges).collect()) == whole(3)
    assert sorted(tuple(r) for r in graph.four_cliques(edges).collect()) == whole(4)


def test_components_of_hubs_chains_and_unknown_ids(spark):
    edges = [(k, 100) for k in range(1, 60)] + [(k, k + 1) for k in range(200, 260)] + [(7, 7), (900, 901), (300, 5000)]
    nodes = spark.createDataFrame([(k,) for k in [*range(1, 60), 100, *range(200, 261), 300, 901]], "id long")
    by_most = [{r.id: r.comp for r in graph.connected_components(nodes, spark.createDataFrame(edges, "src long, dst long"), cutter(spark, "t"), most).collect()} for most in (50_000, 0)]
    got = by_most[0]
    assert got == by_most[1]
    assert {got[k] for k in [*range(1, 60), 100]} == {1} and {got[k] for k in range(200, 261)} == {200} and got[300] == 300 and got[901] == 901
    names = graph.connected_components(nodes.select(F.col("id").cast("string").alias("id")), spark.createDataFrame([("300", "901")], "src string, dst string"), cutter(spark, "t"))
    assert {r.id: r.comp for r in names.collect()}["901"] == "300"


def test_split_joins_beyond_the_broadcast(spark):
    from loomspark.operators.skew import hot_split_join

    left = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(100)] + [(None, -1)], "key long, v long")
    right = left.groupBy("key").agg(F.count("*").alias("n"))
    both = [sorted(map(tuple, hot_split_join(left, right, "key", "n", 4, most).collect())) for most in (50_000, 0)]
    assert both[0] == both[1] and len(both[0]) == 100


def test_hubs_come_in_parts(spark):
    edges = spark.createDataFrame([(k, 0) for k in range(50)] + [(1, 9), (1, 9)], "src long, dst long")
    rows = hetero.neighbor_index(edges, part_rows=10).collect()
    assert sorted(x for r in rows if r.dst == 0 for x in r.neighbors) == list(range(50)) and len([r for r in rows if r.dst == 0]) > 1
    assert [(r.part, r.neighbors) for r in rows if r.dst == 9] == [(0, [1, 1])]


def test_preorder_over_all_edges(spark):
    nodes = spark.createDataFrame([(1, x) for x in ("0", "0.a", "0.b", "0.c", "far")], "doc_id long, id string")
    edges = spark.createDataFrame([(1, "0", "0.a", 0), (1, "0", "0.b", 1), (1, "0", "0.c", 2), (1, "0.a", "0.c", 9), (1, "0.c", "0", 9)], "doc_id long, src string, dst string, ord int")
    assert [r.id for r in graph.preorder_edges(nodes, edges).orderBy("k").collect()] == ["0", "0.a", "0.c", "0.b"]


def test_trees_stop_and_gates(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n\nc d\n\ne"), (2, None)], "doc_id long, text string")
    t = tree.build_tree(docs, [segment.paragraphs], 5, cut=lambda df, k: cutter(spark, "t")(df, k))
    assert sorted(r.level for r in t.collect()) == [0, 0, 1, 1, 1, 1]
    open_tree = tree.OpenTree(t)
    with pytest.raises(RuntimeError):
        open_tree.semantic_edges(None)
    pairs = spark.createDataFrame([(1, "0", "0.0-000001", 0.9), (1, "0.0-000002", "0.0-000001", 0.8), (1, "0.0-000002", "nowhere", 0.8)], "doc_id long, src string, dst string, weight double")
    assert [(r.src, r.dst) for r in open_tree.complete().semantic_edges(pairs).collect()] == [("0.0-000002", "0.0-000001")]
    done = t.select("doc_id", "seg_id", F.lit(0).alias("rule_idx"))
    assert tree.unprocessed(t, done.filter("seg_id = '0'"), 0).count() == 4 and tree.fully_processed(t, done, 1).count() == 6
    assert not tree.has_pending(open_tree.pending(done, 1)) and tree.has_pending(open_tree.pending(done, 2))
    assert tree.embedding_requests(t).columns == ["doc_id", "seg_id", "content"]


def test_upsert_keeps_the_latest(spark):
    e = spark.createDataFrame([(1, 2, 0.1, 1), (1, 2, 0.9, 5), (2, 1, 0.3, 2)], "src long, dst long, weight double, t long")
    assert sorted((r.src, r.dst, r.weight) for r in graph.upsert_edges(e, "t").collect()) == [(1, 2, 0.9), (2, 1, 0.3)]


def test_pieces_at_tokens(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "whole"), (3, ""), (4, None)], "doc_id long, text string")
    tokens = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (1, 2, 6), (2, 0, 0)], "doc_id long, tok_idx long, begin long")
    cuts = spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "doc_id long, position long")
    got = sorted((r.doc_id, r.ord, r.start_pos, r.content) for r in segment.cut_at_tokens(docs, cuts, tokens).collect())
    assert got == [(1, 0, 0, "aa bb"), (1, 1, 6, "cc"), (2, 0, 0, "whole"), (3, 0, 0, "")]


def test_low_rank_attention_at_full_rank(spark):
    """With all ranks kept, block by block attention of one block, and constrained attention, are the plain softmax."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 4))
    df = spark.createDataFrame([(0, i, [float(v) for v in x[i]]) for i in range(6)], "window_idx long, i long, vec array<double>")
    soft = lambda s: np.exp(s - s.max(1, keepdims=True)) / np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True)
    scores = spark.createDataFrame([(0, h, i, j, float(x[i] @ x[j]) * (h + 1)) for h in range(2) for i in range(6) for j in range(6)], "window_idx long, head long, i long, j long, s double")
    got = {(r.i, r.j): r.w for r in attention.constrained_low_rank(scores, 1.0).collect()}
    want = (soft(x @ x.T) + soft(2 * x @ x.T)) / 2
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(6) for j in range(6))

    def cut(m, r):
        u, s, v = np.linalg.svd(m)
        return (u[:, :r] * s[:r]) @ v[:r]

    out = {r.i: r.out for r in attention.blockwise_attention(df, 2, block=3).collect()}
    want = np.zeros((6, 4))
    for h in (0, 1):
        q = x[:, 2 * h : 2 * h + 2]
        for a in (0, 3):
            for b in (0, 3):
                want[a : a + 3, 2 * h : 2 * h + 2] += soft(cut(q[a : a + 3] @ q[b : b + 3].T / np.sqrt(2), 1)) @ q[b : b + 3]
    assert np.allclose([out[i] for i in range(6)], want)


def test_official_splits(spark, tmp_path):
    import gzip

    nodes = spark.range(30)
    assert hetero.split_or_official(nodes, str(tmp_path / "absent")).count() == 30
    for part, ids in (("train", range(20)), ("valid", (20, 21)), ("test", (25, 99))):
        with gzip.open(tmp_path / f"{part}.csv.gz", "wt") as f:
            f.write("\n".join(map(str, ids)) + "\n")
    got = {r.id: r.part for r in hetero.split_or_official(nodes, str(tmp_path)).collect()}
    assert len(got) == 23 and got[3] == "train" and got[21] == "valid" and got[25] == "test"


def test_null_texts_in_windows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in windows.token_windows(docs).collect()) == [(2, 0), (3, 2)]
    assert sorted((r.doc_id, r.text) for r in windows.context_windows(docs).collect()) == [(2, ""), (3, "a b")]


def test_deduplicated_files(spark, tmp_path):
    from loomspark.sources import sinks

    docs = spark.createDataFrame([(7, "# A\ntext of it\n# B\ntext of it\n")], "doc_id long, text string")
    sinks.write_deduplicated(docs, f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").filter("value LIKE '%text of it%'").count() == 1


def test_strategies(spark):
    with pytest.raises(ValueError):
        synth.reassemble(spark.range(1), "nothing")
    with pytest.raises(ValueError):
        segment.segmenter("nothing")


def test_similar_pairs_any_grid(spark):
    rows = spark.createDataFrame([(k, [float(k % 3), 1.0, float(k)]) for k in range(30)], "id long, vec array<float>")
    a = {(r.src, r.dst) for r in vectors.similar_pairs(rows, 100.0, 100).collect()}
    assert a == {(r.src, r.dst) for r in vectors.similar_pairs(rows, 100.0, 7).collect()} and a


def test_split_is_stable(spark):
    nodes = spark.range(500)
    a = {r.id: r.part for r in hetero.split(nodes).collect()}
    b = {r.id: r.part for r in hetero.split(nodes.filter("id < 100")).collect()}
    assert all(a[k] == v for k, v in b.items()) and 0.7 < sum(v == "train" for v in a.values()) / 500 < 0.9


def test_sources(spark, tmp_path):
    (tmp_path / "n.ipynb").write_text('{"cells": [{"cell_type": "code", "source": ["a\\n", "b"]}]}')
    assert tapes.notebook_cells(spark, str(tmp_path / "n.ipynb")).first().source == "a\nb"
    assert tapes.files_or_literal(spark, str(tmp_path / "absent"), "inline").first().text == "inline"
    (tmp_path / "m.csv").write_text("1,2\n3,4\n")
    assert tapes.csv_without_header(spark, str(tmp_path / "m.csv"), "a int, b int").count() == 2


def test_all_queries_match_their_oracles(sf_dir):
    """In a process of its own, with DuckDB before Spark."""
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    from loomspark.plans import catalogue

    names = sorted(catalogue.queries())
    out = subprocess.run([sys.executable, f"{root}/scripts/compare.py", sf_dir, *names], capture_output=True, text=True, timeout=900, cwd=root)
    bad = [x for x in out.stdout.splitlines() if "DIFFERS" in x or "FAILED" in x]
    assert out.returncode == 0 and not bad, "\n".join(bad)

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.config import EngineConfig, get_config
from loomspark.functions import models
from loomspark.operators import dedup, graph, segment, synth, windows
from loomspark.sources import sinks
from loomspark.sources.scratch import cutter

TEXT = st.text(st.sampled_from(list("ab. #`\n\t-é")), max_size=60)
ONCE = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@ONCE
@given(texts=st.lists(TEXT, min_size=1, max_size=8))
def test_paragraphs_are_what_python_gives(spark, texts):
    got = [r.x for r in frame(spark, texts).select("doc_id", segment.paragraphs(F.col("text")).alias("x")).orderBy("doc_id").collect()]
    assert got == [[p.strip() for p in t.split("\n\n") if p.strip()] for t in texts]


@ONCE
@given(texts=st.lists(TEXT, min_size=1, max_size=8))
def test_dedup_twice_is_dedup_once(spark, texts):
    once = dedup.deduplicate_markdown(frame(spark, texts)).select("doc_id", "text")
    kept = [(r.doc_id, r.text) for r in once.collect()]
    again = {r.doc_id: r.text for r in dedup.deduplicate_markdown(frame(spark, [t for _, t in sorted(kept)])).collect()}
    for k, t in kept:
        assert again[sorted(kept).index((k, t))] == t or "```" in t  # cutting a block can leave new repeats


@ONCE
@given(texts=st.lists(st.text(st.sampled_from(list("xyz  \n")), max_size=120), min_size=1, max_size=6), size=st.integers(5, 60))
def test_windows_cover_all_words(spark, texts, size):
    rows = windows.context_windows(frame(spark, texts), size).collect()
    for k, t in enumerate(texts):
        held = " ".join(r.text for r in rows if r.doc_id == k).split()
        assert set(t.split()) <= set(held)


@ONCE
@given(texts=st.lists(TEXT, min_size=1, max_size=6))
def test_chunks_join_to_the_text(spark, texts):
    rows = frame(spark, texts).select("doc_id", segment.fixed_chunks(F.col("text"), 7).alias("x")).collect()
    assert {r.doc_id: "".join(r.x) for r in rows} == dict(enumerate(texts))


@ONCE
@given(texts=st.lists(TEXT, min_size=1, max_size=6))
def test_sections_are_what_python_gives(spark, texts):
    got = {}
    for r in segment.sections(frame(spark, texts)).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.level, r.title, r.content, r.start_line))
    for k, t in enumerate(texts):
        want, cur = [], [0, "Preamble", "", 0]
        for n, line in enumerate(t.split("\n")):
            m = re.match(r"^(#{1,6})\s+(.+)$", line)
            if m:
                want.append(tuple(cur))
                cur = [len(m[1]), m[2].strip(), line + "\n", n]
            else:
                cur[2] += line + "\n"
        want.append(tuple(cur))
        assert got.get(k, []) == [w for w in want if w[2].strip()]


def test_models_and_segmenters(spark):
    docs = frame(spark, ["a b a", "", "é!"])
    norms = [sum(x * x for x in r.e) for r in docs.select(models.hashed_embedding(F.col("text"), 8).alias("e")).collect()]
    assert [round(n, 9) for n in norms] == [1.0, 0.0, 1.0]
    pieces = models.segments_table(docs, models.python_segmenter(lambda t: t.split())).collect()
    assert [(r.doc_id, r.content) for r in pieces] == [(0, "a"), (0, "b"), (0, "a"), (2, "é!")]
    pairs = docs.select(F.col("text").alias("a_text"), F.lit("x").alias("b_text"))
    assert {r.relation for r in models.classify_pairs(pairs, lambda a, b: ["explains", "nonsense", "depends_on"][: len(a)]).collect()} <= {"explains", "unknown", "depends_on"}
    assert {r.relation for r in models.classify_pairs(pairs).collect()} == {"no_relation"}
    assert [r.answer for r in models.generate(docs.withColumnRenamed("text", "prompt"), lambda p: [x.upper() for x in p]).collect()] == ["A B A", "", "É!"]


def test_settings_and_sinks(spark, tmp_path):
    assert get_config({"window_size": 9, "absent": 1}) == EngineConfig(window_size=9)
    s = spark.createDataFrame([(1, "a", "x", "KEEP"), (1, "b", "yy", "DELETE")], "doc_id long, id string, content string, tag string")
    e = spark.createDataFrame([(1, "a", "b", None)], "doc_id long, src string, dst string, weight double")
    got = json.loads(sinks.node_link(s, e).first().json)
    assert got["links"] == [{"source": "a", "target": "b", "weight": 1.0}] and len(got["nodes"]) == 2
    typed = e.withColumn("edge_type", F.lit(None).cast("int"))
    row = sinks.graph_summary(s, typed, graph.edge_type_dim(spark), cutter(spark, "t")).first()
    assert row.connected and [(x["name"], x.n) for x in row.edge_types] == [("NO_RELATION", 1)] and [(x["name"], x.n) for x in row.tags] == [("DELETE", 1), ("KEEP", 1)]
    # as many links as a tree needs, and one node apart
    four = spark.createDataFrame([(1, x, "x", "KEEP") for x in "abcd"], "doc_id long, id string, content string, tag string")
    ring = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "c", 1), (1, "c", "a", 1)], "doc_id long, src string, dst string, edge_type int")
    assert not sinks.graph_summary(four, ring, graph.edge_type_dim(spark), cutter(spark, "t")).first().connected
    sinks.write_json(s, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert synth.seeded_at_random(frame(spark, ["", "p\n\nq"])).filter("doc_id = 0").first().text == ""

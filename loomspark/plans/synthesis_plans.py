"""Queries: deduplication, seeding, synthesis, heterogeneous graphs, exports and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import dedup as D
from loomspark.operators import graph as G
from loomspark.operators import hetero as H
from loomspark.operators import segment as S
from loomspark.operators import synth as Y
from loomspark.plans.registry import query
from loomspark.plans.text_plans import BREAK, CHUNKS, PARAS, STRIP
from loomspark.sources import tapes

SECTIONS = rf"""
sa AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM H),
sl AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM sa),
sf AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+.+$') AS h FROM sl),
sg AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM sf),
ss AS (SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY n) || chr(10) AS content FROM sg GROUP BY doc_id, sec),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS ord, content FROM ss WHERE trim(content, {STRIP}) <> '')"""


def _norm(c: str) -> str:
    bare = rf"regexp_replace({c}, '(?m)^#{{1,6}}\s+.+$', '', 'g')"
    text = rf"regexp_replace(regexp_replace({bare}, '```[\s\S]*?```', '<CODE_BLOCK>', 'g'), '[*_`#\[\]()]', '', 'g')"
    fillers = "'the','and','or','but','in','on','at','to','for','of','with','by'"
    marks = rf"list_transform(range(len(regexp_extract_all({bare}, '```[\s\S]*?```'))), lambda i: 'CODE_BLOCK_' || i::VARCHAR)"
    return rf"array_to_string(list_concat(list_filter(regexp_split_to_array(lower({text}), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({fillers})), {marks}), ' ')"


@query("dedup_normalize", f"WITH TAPES, {SECTIONS} SELECT doc_id, ord, {_norm('content')} AS normalized, md5({_norm('content')}) AS sig FROM sections")
def dedup_normalize(spark, d):
    s = S.sections(tapes.markdown_pages(spark, d))
    return s.select("doc_id", F.col("ord").cast("long").alias("ord"), D.normalized(F.col("content")).alias("normalized"), D.signature(F.col("content")).alias("sig"))


@query("dedup_sections", f"WITH TAPES, {SECTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, md5({_norm('content')}) ORDER BY ord) AS k FROM sections) SELECT doc_id, ord, content FROM k WHERE k = 1")
def dedup_sections(spark, d):
    return D.unique_sections(S.sections(tapes.markdown_pages(spark, d))).select("doc_id", F.col("ord").cast("long").alias("ord"), "content")


@query(
    "dedup_ratio",
    rf"""WITH TAPES, {SECTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, md5({_norm('content')}) ORDER BY ord) AS k, count(*) OVER (PARTITION BY doc_id) AS a FROM sections),
u AS (SELECT *, trim(regexp_replace(content, '\n{{3,}}', {BREAK}, 'g'), {STRIP}) AS body, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM k WHERE k = 1),
j AS (SELECT doc_id, any_value(a) - count(*) AS duplicates, trim(regexp_replace(string_agg(CASE WHEN r > 1 AND NOT starts_with(body, '#') THEN chr(10) || body ELSE body END, chr(10) ORDER BY ord), '\n{{4,}}', {BREAK} || chr(10), 'g'), {STRIP}) AS text FROM u GROUP BY doc_id)
SELECT H.doc_id, coalesce(j.text, '') AS text, coalesce(duplicates, 0) AS duplicates, round(CASE WHEN length(H.text) > 0 THEN length(coalesce(j.text, '')) / length(H.text) ELSE 1.0 END, 9) AS compression FROM H LEFT JOIN j ON H.doc_id = j.doc_id""",
)
def dedup_ratio(spark, d):
    r = D.deduplicate_markdown(tapes.markdown_pages(spark, d))
    return r.select("doc_id", "text", F.col("duplicates").cast("long").alias("duplicates"), F.round("compression", 9).alias("compression"))


@query("dedup_docs", f"WITH s AS (SELECT doc_id, md5({_norm('text')}) AS sig FROM documents) SELECT sig, min(doc_id) AS doc_id, count(*) AS copies FROM s GROUP BY sig")
def dedup_docs(spark, d):
    return tapes.table(spark, d, "documents").select("doc_id", D.signature(F.col("text")).alias("sig")).groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "dedup_code",
    rf"""WITH ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, i // 6 AS ord, i, i % 3 = 2 AS code, CASE WHEN i % 3 = 2 THEN '```' || chr(10) || x || chr(10) || '```' ELSE x END AS x FROM ls),
b AS (SELECT *, md5(trim(regexp_replace(regexp_replace(regexp_replace(x, '(?m)^```.*$', '', 'g'), '(?m)#.*$', '', 'g'), '\s+', ' ', 'g'), {STRIP})) AS sig FROM p WHERE code),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sig ORDER BY ord, i) = 1 AS first FROM b),
k AS (SELECT doc_id, i, bool_or(first) OVER (PARTITION BY doc_id, ord, x) AS keep FROM f)
SELECT p.doc_id, ord, regexp_replace(string_agg(CASE WHEN code AND NOT keep THEN '' ELSE x END, chr(10) ORDER BY p.i), '\n{{3,}}', chr(10) || chr(10), 'g') AS content FROM p LEFT JOIN k ON p.doc_id = k.doc_id AND p.i = k.i GROUP BY p.doc_id, ord""",
)
def dedup_code(spark, d):
    """Sections of six lines, every third a fenced block."""
    line = F.struct(F.floor(F.col("i") / 6).alias("ord"), "i", F.when(F.col("i") % 3 == 2, F.concat(F.lit("```\n"), "x", F.lit("\n```"))).otherwise(F.col("x")).alias("x"))
    rows = tapes.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x")).select("doc_id", line.alias("l")).select("doc_id", "l.*")
    found = rows.groupBy("doc_id", "ord").agg(X.ordered_join(["i"], F.col("x"), "\n").alias("content")).withColumns({"level": F.lit(1), "title": F.lit(""), "start_line": F.lit(0)})
    return D.unique_code(found).select("doc_id", "ord", "content")


BLOCK = "chr(10) || '        <processing_rules>' || chr(10) || '        <segmentation_rule>Split at natural topic boundaries</segmentation_rule>' || chr(10) || '        <reorganization_rule>Group by theme and importance</reorganization_rule>' || chr(10) || '        </processing_rules>' || chr(10) || '        ' || chr(10) || '        '"


@query(
    "seed_rules",
    f"""WITH TAPES, {CHUNKS},
m AS (SELECT doc_id, i, CASE WHEN i = 0 THEN '<SEGMENT rule=''Split at natural topic boundaries''>' || x || '</SEGMENT>' WHEN n >= 3 AND i = n // 2 THEN '<CONNECT rule=''Group by theme and importance''>' || x || '</CONNECT>' WHEN n >= 3 AND i = n - 1 THEN '<ORGANIZE rule=''Group by theme and importance''>' || x || '</ORGANIZE>' ELSE x END AS x FROM C)
SELECT doc_id, {BLOCK} || string_agg(x, {BREAK} ORDER BY i) AS text FROM m GROUP BY doc_id""",
)
def seed_rules(spark, d):
    t = tapes.transcripts(spark, d)
    return t.select("doc_id", Y.seeded_with_rules(F.col("text")).alias("text"))


def seeds_sql(density: float, types: list[str], prefix: str = "", seed: int = 7) -> str:
    hints = " || chr(10) || ".join(f"'{x}'" for x in Y.HINTS.split("\n"))
    return f"""WITH TAPES, {CHUNKS},
hit AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || ':' || i || ':{seed}'), i) <= greatest(1, floor(n * {density}::DOUBLE)) AS take,
  ({types!r})[('0x' || substring(md5(doc_id || ':' || i || ':{seed + 1}'), 1, 8))::BIGINT % {len(types)} + 1] AS tag FROM C)
SELECT doc_id, '{prefix}' || {hints} || {BREAK} || string_agg(CASE WHEN take THEN '<' || tag || '>' || x || '</' || tag || '>' ELSE x END, {BREAK} ORDER BY i) AS text FROM hit GROUP BY doc_id"""


@query("seed_hash_sample", seeds_sql(0.15, Y.INSTRUCTIONS))
def seed_hash(spark, d):
    return Y.seeded_at_random(tapes.transcripts(spark, d), 0.15)


@query("seed_rule_prompt", "SELECT doc_id, 'Rule: keep facts' || chr(10) || chr(10) || 'Text: ' || text AS prompt FROM documents")
def seed_prompt(spark, d):
    return tapes.table(spark, d, "documents").select("doc_id", Y.rule_prompt(F.lit("keep facts"), F.col("text")).alias("prompt"))


SEGS = f"""{PARAS.format(tape='T')},
O AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord FROM P),
G AS (SELECT doc_id, 'n' || lpad(ord::VARCHAR, 3, '0') AS id, content, ord AS start_pos, round(length(content) / 1000.0, 3)::DOUBLE AS importance, ord % 4 = 1 AS has_code, ord % 4 = 2 AS has_math,
      CASE WHEN ord % 7 = 6 THEN 'DELETE' ELSE 'KEEP' END AS tag, CASE WHEN ord % 3 = 0 THEN 'foundational' WHEN ord % 3 = 1 THEN 'technical_core' ELSE 'side_note' END AS segment_type FROM O)"""


def _segments(spark, d):
    rows = tapes.transcripts(spark, d).select("doc_id", F.posexplode(S.paragraphs(F.col("text"))).alias("ord", "content"))
    o = F.col("ord")
    return rows.select(
        "doc_id", F.concat(F.lit("n"), F.lpad(o.cast("string"), 3, "0")).alias("id"), F.concat(F.lit("n"), F.lpad(o.cast("string"), 3, "0")).alias("seg_id"), "content", o.alias("start_pos"),
        F.round(F.length("content") / F.lit(1000.0), 3).alias("importance"), (o % 4 == 1).alias("has_code"), (o % 4 == 2).alias("has_math"),
        F.when(o % 7 == 6, "DELETE").otherwise("KEEP").alias("tag"), F.when(o % 3 == 0, "foundational").when(o % 3 == 1, "technical_core").otherwise("side_note").alias("segment_type"),
    )


NL = "chr(10)"


@query("doc_exec_summary", f"WITH TAPES, {SEGS}, k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, start_pos, id) AS k FROM G WHERE tag <> 'DELETE') SELECT doc_id, '# Executive Summary' || {BREAK} || 'This document summarizes ' || any_value(n) || ' key concepts, focusing on the most critical insights.' || {BREAK} || string_agg('## ' || id || {NL} || content || {NL}, {NL} ORDER BY k) AS text FROM k WHERE k <= 5 GROUP BY doc_id")
def doc_exec(spark, d):
    return Y.reassemble(_segments(spark, d), "executive_summary")


@query("doc_tutorial", f"WITH TAPES, {SEGS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, id) AS k FROM G WHERE tag <> 'DELETE') SELECT doc_id, '# Tutorial' || {BREAK} || {NL} || string_agg('## Step ' || k || ': ' || id || {BREAK} || {NL} || content || CASE WHEN has_code THEN {BREAK} || {NL} || '*Example Code Block Included*' ELSE '' END, {BREAK} ORDER BY k) AS text FROM k GROUP BY doc_id")
def doc_tutorial(spark, d):
    return Y.reassemble(_segments(spark, d), "tutorial")


@query("doc_reference", f"WITH TAPES, {SEGS}, k AS (SELECT *, CASE WHEN has_code THEN 'Code' WHEN has_math THEN 'Math' ELSE 'Text' END AS kind FROM G WHERE tag <> 'DELETE'), f AS (SELECT *, min(start_pos) OVER (PARTITION BY doc_id, kind) AS first FROM k) SELECT doc_id, '# Reference Guide' || {BREAK} || string_agg(CASE WHEN start_pos = first THEN '## ' || kind || ' Segments' || {BREAK} ELSE '' END || '### ID: ' || id || {NL} || content || {NL}, {NL} ORDER BY first, start_pos) AS text FROM f GROUP BY doc_id")
def doc_reference(spark, d):
    return Y.reassemble(_segments(spark, d), "reference")


@query("doc_readme", f"WITH TAPES, {SEGS}, k AS (SELECT * FROM G WHERE tag <> 'DELETE'), c AS (SELECT doc_id, string_agg('### Feature: ' || id || {NL} || content || {NL}, {NL} ORDER BY start_pos) AS code FROM k WHERE has_code GROUP BY doc_id), i AS (SELECT doc_id, arg_min(content, start_pos) AS intro FROM k GROUP BY doc_id) SELECT i.doc_id, '# Project README' || {BREAK} || '## Overview' || {NL} || intro || {NL} || coalesce({NL} || '## Features & Examples' || {BREAK} || code, '') AS text FROM i LEFT JOIN c ON i.doc_id = c.doc_id")
def doc_readme(spark, d):
    return Y.reassemble(_segments(spark, d), "readme")


@query(
    "doc_narrative",
    f"""WITH TAPES, {SEGS},
k AS (SELECT *, min(start_pos) OVER (PARTITION BY doc_id, segment_type) AS first, row_number() OVER (PARTITION BY doc_id, segment_type ORDER BY importance DESC, start_pos) AS k, count(*) OVER (PARTITION BY doc_id, segment_type) AS n,
  list_filter(list_transform(string_split(content, '.'), lambda s: trim(s, {STRIP})), lambda s: length(s) > 20) AS long FROM G),
th AS (SELECT doc_id, segment_type, any_value(first) AS first, arg_min(CASE WHEN len(long) > 0 THEN long[1] ELSE 'Important conceptual development' END, k) AS insight,
  {NL} || '## ' || CASE segment_type WHEN 'foundational' THEN 'Foundational Principles' WHEN 'technical_core' THEN 'Technical Deep Dive' ELSE 'Side Note' END || {BREAK} || {NL} ||
  string_agg(CASE WHEN k = 1 THEN '' WHEN k = 2 THEN 'Let''s begin by examining...' || {BREAK} WHEN k = n THEN 'Finally, we arrive at...' || {BREAK} WHEN k % 2 = 1 THEN 'Continuing our exploration...' || {BREAK} ELSE 'This naturally leads us to...' || {BREAK} END || content, {BREAK} ORDER BY k) AS thread
  FROM k GROUP BY doc_id, segment_type)
SELECT doc_id, '# A Journey Through Connected Concepts' || {BREAK} || 'This narrative explores ' || count(*) || ' interconnected themes, weaving together technical insights, foundational principles, and practical applications.' || {NL} || {BREAK} ||
  string_agg(thread, {BREAK} ORDER BY first) || {BREAK} || {NL} || '## Synthesis' || {BREAK} || 'Our journey through these concepts reveals several key insights:' || {BREAK} || string_agg('- ' || insight, {NL} ORDER BY first) || {BREAK} ||
  'These threads weave together to form a comprehensive understanding of the subject matter, each contributing essential perspectives to the whole.' AS text
FROM th GROUP BY doc_id""",
)
def doc_narrative(spark, d):
    return Y.narrative(_segments(spark, d))


@query("doc_linear", f"WITH TAPES, {SEGS} SELECT doc_id, string_agg(content, {BREAK} ORDER BY importance DESC, id) AS text FROM G WHERE tag <> 'DELETE' GROUP BY doc_id")
def doc_linear(spark, d):
    return Y.linear(_segments(spark, d))


@query("doc_type_summary", f"WITH TAPES, {SEGS}, e AS (SELECT doc_id, count(*) - 1 AS e FROM G GROUP BY doc_id HAVING count(*) > 1), tt AS (SELECT doc_id, segment_type AS kind, count(*) AS c FROM G GROUP BY ALL) SELECT tt.doc_id, 'This document synthesizes ' || sum(c)::BIGINT || ' interconnected concepts with ' || any_value(coalesce(e.e, 0)) || ' relationships. The content includes ' || string_agg(c || ' ' || CASE kind WHEN 'foundational' THEN 'foundational principles' WHEN 'technical_core' THEN 'technical deep dive' ELSE 'side note' END, ', ' ORDER BY c DESC, kind) || '.' AS text FROM tt LEFT JOIN e ON tt.doc_id = e.doc_id GROUP BY tt.doc_id")
def doc_summary(spark, d):
    s = _segments(spark, d)
    return Y.type_summary(s, _chain(s))


CHAIN = "chain AS (SELECT * FROM (SELECT doc_id, id AS src, lead(id) OVER (PARTITION BY doc_id ORDER BY start_pos) AS dst FROM G) WHERE dst IS NOT NULL)"


def _chain(s):
    nxt = F.lead("id").over(Window.partitionBy("doc_id").orderBy("start_pos"))
    return s.withColumn("dst", nxt).filter("dst IS NOT NULL").select("doc_id", F.col("id").alias("src"), "dst", F.lit(9).alias("edge_type"), F.lit(1.0).alias("weight"))


@query("doc_reading_context", rf"WITH TAPES, {SEGS} SELECT doc_id, string_agg(content, '\n\n---\n\n' ORDER BY id) AS text FROM G WHERE tag = 'KEEP' GROUP BY doc_id")
def doc_context(spark, d):
    return Y.reading_context(_segments(spark, d), compat=True)


@query("doc_top30", f"WITH TAPES, {SEGS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, id) AS rank FROM G WHERE tag = 'KEEP') SELECT doc_id, id, rank, importance, CASE WHEN has_code THEN 'technical_core' ELSE 'foundational' END AS segment_type FROM k WHERE rank <= 30")
def doc_top(spark, d):
    return Y.most_important(_segments(spark, d)).select("doc_id", "id", F.col("rank").cast("long").alias("rank"), "importance", "segment_type")


@query("doc_guided")
def doc_guided(spark, d):
    s = _segments(spark, d)
    return Y.guided(s, _chain(s))


@query("doc_export_segments", f"WITH TAPES, {SEGS} SELECT doc_id, id, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS preview, length(content) AS full_length, has_code, has_math FROM G")
def doc_export(spark, d):
    return Y.exported_segments(_segments(spark, d)).withColumn("full_length", F.col("full_length").cast("long"))


@query(
    "doc_export_graphml",
    f"""WITH TAPES, {SEGS}, {CHAIN},
n AS (SELECT doc_id, string_agg('<node id="' || id || '"><data key="tag">' || tag || '</data><data key="content_length">' || length(content) || '</data><data key="importance">' || importance || '</data></node>', '' ORDER BY id) AS n FROM G GROUP BY doc_id),
e AS (SELECT doc_id, string_agg('<edge source="' || src || '" target="' || dst || '"><data key="edge_type">9</data><data key="weight">1.0</data></edge>', '' ORDER BY src, dst) AS e FROM chain GROUP BY doc_id)
SELECT n.doc_id, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">' || n || coalesce(e, '') || '</graph></graphml>' AS text FROM n LEFT JOIN e ON n.doc_id = e.doc_id""",
)
def doc_graphml(spark, d):
    s = _segments(spark, d)
    return Y.graphml(s, _chain(s))


TYPED_CHAIN = f"{SEGS}, {CHAIN}, te AS (SELECT doc_id, src, dst, CASE WHEN src LIKE '%1' THEN NULL ELSE right(src, 1)::INT END AS edge_type, CASE WHEN src LIKE '%2' THEN NULL ELSE 0.5::DOUBLE END AS weight, CASE WHEN src LIKE '%3' THEN NULL ELSE 'semantic' END AS type FROM chain), dim(code, name) AS (VALUES {', '.join(f'({i}, {n!r})' for i, n in enumerate(G.EDGE_TYPES))}), xe AS (SELECT doc_id, src, dst, coalesce(weight, 1.0) AS weight, coalesce(type, 'unknown') AS type, name AS edge_type_name FROM te JOIN dim ON dim.code = coalesce(edge_type, 0))"


def _typed_chain(spark, s):
    digit = F.substring("src", -1, 1)
    rows = _chain(s).select("doc_id", "src", "dst", F.when(digit != "1", digit.cast("int")).alias("edge_type"), F.when(digit != "2", F.lit(0.5)).alias("weight"), F.when(digit != "3", F.lit("semantic")).alias("type"))
    return Y.exported_edges(rows, G.edge_type_dim(spark))


@query("doc_export_edges", f"WITH TAPES, {TYPED_CHAIN} SELECT doc_id, src, dst, weight, type, edge_type_name FROM xe")
def doc_export_edges(spark, d):
    return _typed_chain(spark, _segments(spark, d))


@query(
    "doc_export_structure",
    f"""WITH TAPES, {TYPED_CHAIN},
a AS (SELECT doc_id, string_agg(tag || '=' || c, ',' ORDER BY tag) AS tags, sum(c)::BIGINT AS nodes FROM (SELECT doc_id, tag, count(*) AS c FROM G GROUP BY ALL) GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(edge_type_name || '=' || c, ',' ORDER BY edge_type_name) AS edge_types, sum(c)::BIGINT AS edges FROM (SELECT doc_id, edge_type_name, count(*) AS c FROM xe GROUP BY ALL) GROUP BY doc_id)
SELECT a.doc_id, nodes, tags, coalesce(edges, 0) AS edges, coalesce(edge_types, '') AS edge_types FROM a LEFT JOIN b ON a.doc_id = b.doc_id""",
)
def doc_export_structure(spark, d):
    s = _segments(spark, d)
    shown = lambda c: F.coalesce(F.array_join(F.transform(c, lambda e: F.concat(e["name"], F.lit("="), e["n"].cast("string"))), ","), F.lit("")).alias(c)
    return Y.exported_structure(s, _typed_chain(spark, s)).select("doc_id", "nodes", shown("tags"), "edges", shown("edge_types"))


@query(
    "doc_reconstruction",
    f"""WITH TAPES, {SEGS}, {CHAIN},
x AS (SELECT doc_id, length(string_agg(content, {BREAK} ORDER BY importance DESC, id)) AS n FROM G WHERE tag <> 'DELETE' GROUP BY doc_id),
y AS (SELECT doc_id, length(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY id)) AS n FROM G WHERE tag = 'KEEP' GROUP BY doc_id),
sz AS (SELECT doc_id, count(*) AS nodes, count(*) FILTER (WHERE tag = 'KEEP') AS kept FROM G GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS edges FROM chain GROUP BY doc_id)
SELECT T.doc_id, length(T.text)::BIGINT AS original_length, y.n::BIGINT AS context_length, round(y.n / length(T.text), 9) AS context_ratio, x.n::BIGINT AS linear_length, round(x.n / length(T.text), 9) AS linear_ratio, nodes, kept, coalesce(edges, 0) AS edges
FROM T JOIN x ON x.doc_id = T.doc_id JOIN y ON y.doc_id = T.doc_id JOIN sz ON sz.doc_id = T.doc_id LEFT JOIN c ON c.doc_id = T.doc_id""",
)
def doc_reconstruction(spark, d):
    s = _segments(spark, d)
    original = tapes.transcripts(spark, d).withColumnRenamed("text", "original")
    texts = Y.linear(s).withColumn("strategy", F.lit("linear")).unionByName(Y.reading_context(s).withColumn("strategy", F.lit("context")))
    r = Y.reconstruction_report(texts.join(original, "doc_id"), s, _chain(s))
    of = lambda k, f: F.element_at("strategies", k)[f]
    return r.select("doc_id", F.col("original_length").cast("long").alias("original_length"), of(1, "length").cast("long").alias("context_length"), F.round(of(1, "ratio"), 9).alias("context_ratio"), of(2, "length").cast("long").alias("linear_length"), F.round(of(2, "ratio"), 9).alias("linear_ratio"), "nodes", "kept", "edges")


@query("doc_timeline", "SELECT conv_id, turn, role, text FROM conversations")
def doc_timeline(spark, d):
    return tapes.table(spark, d, "conversations").select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")


@query("doc_by_speaker", f"SELECT conv_id, role, string_agg(text, {BREAK} ORDER BY turn) AS text, count(*) AS turns FROM conversations GROUP BY ALL")
def doc_by_speaker(spark, d):
    return tapes.table(spark, d, "conversations").groupBy("conv_id", "role").agg(X.ordered_join(["turn"], F.col("text"), X.BREAK).alias("text"), F.count("*").alias("turns"))


@query("doc_current_state", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def doc_state(spark, d):
    last = F.max(F.struct("turn", "role", "text")).alias("x")
    return tapes.table(spark, d, "conversations").groupBy("conv_id").agg(last).select("conv_id", "x.*")


EDGES = "edges AS (SELECT o_orderkey AS src, o_custkey AS dst FROM orders)"


def _edges(spark, d):
    return tapes.table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))


@query("het_neighbor_index", f"WITH {EDGES} SELECT dst, list_sort(list(src)) AS neighbors FROM edges GROUP BY dst")
def het_index(spark, d):
    return H.neighbor_index(_edges(spark, d)).select("dst", "neighbors")


def _fan(edges: str, k: int, seed: int) -> str:
    return f"SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY md5(src::VARCHAR || ':' || dst::VARCHAR || ':{seed}'), src) AS k FROM {edges}) WHERE k <= {k}"


@query("het_fanout2", f"WITH {EDGES} {_fan('edges', 2, 0)}")
def het_fan(spark, d):
    return H.fan_out(_edges(spark, d), 2)


PARTS = "pe AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem UNION ALL SELECT l_partkey + 100000000, l_orderkey FROM lineitem)"


@query(
    "het_minibatch_2hop",
    f"""WITH {PARTS}, s AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 50 = 0),
o1 AS (SELECT * FROM pe WHERE dst IN (SELECT id FROM s)), h1 AS ({_fan('o1', 5, 1)}), f1 AS (SELECT DISTINCT src AS id FROM h1),
o2 AS (SELECT * FROM pe WHERE dst IN (SELECT id FROM f1)), h2 AS ({_fan('o2', 3, 2)}), f2 AS (SELECT DISTINCT src AS id FROM h2)
SELECT id, min(hop)::BIGINT AS hop FROM (SELECT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM f1 UNION ALL SELECT id, 2 FROM f2) GROUP BY id""",
)
def het_minibatch(spark, d):
    li = tapes.table(spark, d, "lineitem")
    pe = li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).unionByName(li.select((F.col("l_partkey") + 100000000).alias("src"), F.col("l_orderkey").alias("dst")))
    seeds = tapes.table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"))
    return H.mini_batch(seeds, pe, [5, 3]).withColumn("hop", F.col("hop").cast("long"))


@query("het_batch_edges", f"WITH {EDGES}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT src AS id FROM edges WHERE src % 5 = 0 UNION SELECT DISTINCT dst FROM edges WHERE dst % 3 = 0)) SELECT e.src, e.dst, a.idx AS src_idx, b.idx AS dst_idx FROM edges e JOIN n a ON e.src = a.id JOIN n b ON e.dst = b.id")
def het_batch(spark, d):
    e = _edges(spark, d)
    nodes = e.filter("src % 5 = 0").select(F.col("src").alias("id")).unionByName(e.filter("dst % 3 = 0").select(F.col("dst").alias("id")))
    r = H.batch_edges(nodes, e)
    return r.withColumns({c: F.col(c).cast("long") for c in ("src_idx", "dst_idx")})


@query("het_touching_edges", f"WITH {EDGES} SELECT src, dst FROM edges WHERE src % 100 = 0 OR dst % 100 = 0")
def het_touching(spark, d):
    e = _edges(spark, d)
    nodes = e.filter("src % 100 = 0").select(F.col("src").alias("id")).unionByName(e.filter("dst % 100 = 0").select(F.col("dst").alias("id")))
    a = H.touching(e, nodes)
    return a.filter("src % 100 = 0 OR dst % 100 = 0").select("src", "dst")


@query("het_minibatches", "SELECT c_custkey AS id, ((row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || ':3')) - 1) // 64)::BIGINT AS batch FROM customer")
def het_batches(spark, d):
    return H.batches(tapes.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 64, 3)


@query("het_split", "SELECT c_custkey AS id, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'valid' ELSE 'test' END AS part FROM (SELECT c_custkey, ('0x' || substring(md5(c_custkey::VARCHAR || ':42'), 1, 4))::INT % 10 AS b FROM customer)")
def het_split(spark, d):
    return H.split(tapes.table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("het_metrics", "SELECT round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS loss, round(avg(l_discount), 6) AS mean_seconds, round(sum(l_quantity) / sum(l_discount), 3) AS samples_per_second FROM lineitem")
def het_metrics(spark, d):
    li = tapes.table(spark, d, "lineitem").select(F.col("l_tax").alias("loss"), F.col("l_quantity").alias("samples"), F.col("l_discount").alias("seconds"))
    return H.training_metrics(li).select(F.round("loss", 6).alias("loss"), F.round("mean_seconds", 6).alias("mean_seconds"), F.round("samples_per_second", 3).alias("samples_per_second"))


@query("het_accuracy", "SELECT count(*) AS n, round(avg((quality = 1 - toxic)::INT), 9) AS accuracy FROM labels")
def het_accuracy(spark, d):
    r = H.accuracy(tapes.table(spark, d, "labels"), F.col("quality"), 1 - F.col("toxic"))
    return r.withColumn("accuracy", F.round("accuracy", 9))


@query("het_cache_report", "WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0) SELECT count(DISTINCT o_orderkey) AS calls, count(*) AS nodes, count(c.id) AS hits, round(count(c.id) / nullif(count(DISTINCT o_orderkey), 0), 9) AS hit_rate FROM orders LEFT JOIN c ON o_custkey = c.id")
def het_cache(spark, d):
    req = tapes.table(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("id"))
    r = H.cache_report(req, tapes.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")))
    return r.withColumn("hit_rate", F.round("hit_rate", 9))


@query("ev_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ev_tumbling(spark, d):
    e = tapes.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.groupBy(F.window(F.col("ts"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("ev_session", "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s")
def ev_session(spark, d):
    e = tapes.table(spark, d, "events")
    return e.groupBy(F.session_window(F.col("ts"), "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("ev_json_props", "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def ev_json(spark, d):
    return tapes.table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))

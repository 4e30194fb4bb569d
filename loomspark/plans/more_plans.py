"""Queries: the remaining small operators, exports and rule-driven parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.config import DEFAULT_RULE_SET, RULE_SETS
from loomspark.functions import models as M
from loomspark.functions import text as X
from loomspark.operators import align as L
from loomspark.operators import attention as A
from loomspark.operators import graph as G
from loomspark.operators import hetero as H
from loomspark.operators import segment as S
from loomspark.operators import synth as Y
from loomspark.operators import tree as R
from loomspark.operators import vectors as V
from loomspark.operators import windows as W
from loomspark.plans import attention_plans as AP
from loomspark.plans import graph_plans as GP
from loomspark.plans import synthesis_plans as SP
from loomspark.plans.registry import query
from loomspark.plans.text_plans import BREAK, FENCED, PACK, STRIP, _packed, case_values, fenced
from loomspark.sources import sinks, tapes
from loomspark.sources.scratch import cutter


@query("src_rule_lookup", f"WITH r(name, rule) AS (VALUES {case_values(list(RULE_SETS.items()))}), a AS (SELECT conv_id, role, CASE WHEN conv_id % 3 = 0 THEN 'academic_paper' WHEN conv_id % 3 = 1 THEN 'absent' ELSE 'meeting_transcript' END AS name FROM conversations) SELECT conv_id, role, coalesce(r.rule, '{RULE_SETS[DEFAULT_RULE_SET]}') AS rule FROM a LEFT JOIN r ON a.name = r.name")
def src_rules(spark, d):
    rules = spark.createDataFrame(list(RULE_SETS.items()), "name string, rule string")
    name = F.when(F.col("conv_id") % 3 == 0, "academic_paper").when(F.col("conv_id") % 3 == 1, "absent").otherwise("meeting_transcript")
    rows = tapes.table(spark, d, "conversations").select("conv_id", "role", name.alias("name"))
    return rows.join(F.broadcast(rules), "name", "left").select("conv_id", "role", F.coalesce("rule", F.lit(RULE_SETS[DEFAULT_RULE_SET])).alias("rule"))


@query("src_listed_pieces", "SELECT vec_id, unnest(embedding) AS text, (generate_subscripts(embedding, 1) - 1)::BIGINT AS win_idx FROM embeddings")
def src_listed(spark, d):
    r = tapes.listed_pieces(tapes.table(spark, d, "embeddings"), "vec_id", "embedding")
    return r.withColumn("win_idx", F.col("win_idx").cast("long"))


@query("src_fetch_rows", "SELECT o_orderkey AS place, c_custkey AS id, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def src_fetch(spark, d):
    ids = tapes.table(spark, d, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("id"))
    return H.fetch(tapes.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), ids)


@query(
    "seg_by_rule",
    rf"""WITH {FENCED},
m AS (SELECT doc_id, string_split('t' || regexp_replace(text, '(?m)(```[\s\S]*?```|^(?:[ ]{{4,}}|\t).*(?:\n(?:[ ]{{4,}}|\t).*)*)', chr(1) || 'c\1' || chr(1) || 't', 'g'), chr(1)) AS p FROM FT WHERE doc_id % 2 = 0),
k AS (SELECT doc_id, list_filter(list_transform(p, lambda x: CASE WHEN x[1] = 'c' THEN x[2:] ELSE trim(x[2:], {STRIP}) END), lambda x: x <> '') AS k FROM m),
q AS (SELECT doc_id, list_filter(list_transform(string_split(text, {BREAK}), lambda x: trim(x, {STRIP})), lambda x: x <> '') AS q FROM FT)
SELECT q.doc_id, unnest(CASE WHEN len(k) <> 1 THEN k ELSE q END) AS content FROM q LEFT JOIN k ON q.doc_id = k.doc_id""",
)
def seg_by_rule(spark, d):
    t = fenced(spark, d).withColumn("rule", F.when(F.col("doc_id") % 2 == 0, "Isolate code first").otherwise("Split at topics"))
    return t.select("doc_id", F.explode(S.by_rule(F.col("rule"), F.col("text"))).alias("content"))


@query("seg_rule_model", "WITH TAPES, c AS (SELECT doc_id, unnest(range(0, length(text), 1024)) // 1024 AS k, substring(text, unnest(range(0, length(text), 1024)) + 1, 1024) AS chunk FROM L), p AS (SELECT doc_id, k, chunk, list_filter(list_transform(string_split(replace(chunk, '. ', '.---'), '---'), lambda x: trim(x, " + STRIP + ")), lambda x: x <> '') AS ps FROM c) SELECT doc_id, k, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE [chunk] END) AS piece FROM p")
def seg_rule_model(spark, d):
    """The model stands in by a rule that marks sentence ends."""
    chunks = tapes.spaced_documents(spark, d).select("doc_id", F.posexplode(S.fixed_chunks(F.col("text"))).alias("k", "chunk"))
    answer = F.replace("chunk", F.lit(". "), F.lit(".---"))
    return chunks.select("doc_id", F.col("k").cast("long").alias("k"), F.explode(S.delimited(answer, F.col("chunk"))).alias("piece"))


@query("seg_prompt_guided")
def seg_prompt(spark, d):
    return S.prompt_guided(tapes.table(spark, d, "documents"), "the end of the thing", 64, 32, 0.25, 0.005)


@query(
    "win_context",
    rf"""WITH TAPES, {PACK}, k AS (SELECT doc_id, count(*) AS n, max(length(text)) AS m FROM WN GROUP BY doc_id),
fw AS (SELECT T.doc_id, T.text, list_filter(regexp_split_to_array(T.text, '\s+'), lambda x: x <> '') AS w FROM T LEFT JOIN k ON k.doc_id = T.doc_id WHERE k.n IS NULL OR (k.n = 1 AND k.m > 1500)),
fs AS (SELECT *, 200 - CASE WHEN len(w) > 600 THEN 30 WHEN len(w) > 200 THEN 40 ELSE 50 END AS step FROM fw),
fx AS (SELECT doc_id, w, step, unnest(range(0, len(w), step)) AS s FROM fs WHERE len(w) > 0)
SELECT WN.doc_id, WN.win_idx, WN.text FROM WN WHERE doc_id NOT IN (SELECT doc_id FROM fw)
UNION ALL SELECT doc_id, (s // step)::BIGINT, array_to_string(w[s + 1 : s + 200], ' ') FROM fx
UNION ALL SELECT doc_id, 0, text FROM fs WHERE len(w) = 0""",
)
def win_context(spark, d):
    t = tapes.transcripts(spark, d)
    return W.context_windows(t).withColumn("win_idx", F.col("win_idx").cast("long"))


@query("win_clean", r"SELECT page_id, CASE WHEN trim(html, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN '' ELSE regexp_replace(html, '\n{3,}', chr(10) || chr(10), 'g') END AS html, contains(html, '```') OR contains(html, '`') OR contains(html, 'def ') OR contains(html, 'class ') OR contains(html, 'import ') OR contains(html, 'from ') OR contains(html, '#!/') OR contains(html, '</') OR contains(html, '/>') OR contains(html, '{}') OR contains(html, '[]') OR contains(html, '()') AS code FROM pages")
def win_clean(spark, d):
    return tapes.table(spark, d, "pages").select("page_id", X.few_blank_lines(F.col("html")).alias("html"), W.looks_like_code(F.col("html")).alias("code"))


@query("tok_hierarchical", f"WITH {AP.TOKENS}, l AS (SELECT doc_id, tok_idx, k.k AS level, ntile(4) OVER (PARTITION BY doc_id, k.k ORDER BY tok_idx) - 1 AS a, ntile(8) OVER (PARTITION BY doc_id, k.k ORDER BY tok_idx) - 1 AS b FROM tk, (VALUES (0), (1)) k(k)) SELECT doc_id, tok_idx, level::BIGINT AS level, CASE WHEN level = 0 THEN a ELSE b END AS seg_idx FROM l")
def tok_hierarchical(spark, d):
    t = AP._tokens(spark, d)
    both = L.uniform_map(t, 4).withColumn("level", F.lit(0)).unionByName(L.uniform_map(t, 8).withColumn("level", F.lit(1)))
    return AP._longs(both.select("doc_id", "tok_idx", "level", "seg_idx"), "tok_idx", "level", "seg_idx")


@query("vec_hierarchical_means", "WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), a AS (SELECT label, dim, avg(x) AS x FROM f GROUP BY ALL), b AS (SELECT label % 3 AS id, dim, avg(x) AS x FROM a GROUP BY ALL) SELECT id::BIGINT AS id, dim, round(x, 6) AS x FROM b")
def vec_levels(spark, d):
    e = tapes.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    first = e.select("id", F.col("label").cast("long").alias("parent"))
    second = e.select(F.col("label").cast("long").alias("id")).distinct().withColumn("parent", F.col("id") % 3)
    top = V.pooled_levels(e, [first, second])[-1]
    return top.select("id", F.posexplode("vec").alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("vec_window_merge", "WITH f AS (SELECT vec_id % 40 AS node, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT node, dim, round(avg(x), 6) AS value FROM f GROUP BY ALL")
def vec_merge(spark, d):
    r = V.mean_by_node(tapes.table(spark, d, "embeddings").withColumn("node", F.col("vec_id") % 40), "node", "embedding")
    return r.select("node", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("ana_top_by_type", f"WITH {GP.TYPED}, n AS (SELECT coalesce(edge_type, 0) AS edge_type, dst AS id, count(*) AS n FROM typed GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY n DESC, id) AS rank FROM n) SELECT edge_type, rank, id, n FROM r WHERE rank <= 3")
def ana_top_type(spark, d):
    return AP._longs(G.top_by_incoming_type(GP._typed(spark, d)), "edge_type", "rank")


@query("ana_gap_clusters", f"WITH RECURSIVE {GP.E03}, k AS (SELECT id FROM nodes WHERE id % 4 <> 0), b AS (SELECT src, dst FROM both_ways WHERE src % 4 <> 0 AND dst % 4 <> 0), reach AS (SELECT id, id AS r FROM k UNION SELECT b.src, reach.r FROM reach JOIN b ON b.dst = reach.id WHERE reach.r < b.src), c AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id) SELECT cluster, id FROM c QUALIFY count(*) OVER (PARTITION BY cluster) > 1")
def ana_gap(spark, d):
    nodes = GP._nodes(spark, d).withColumn("cohesion", F.when(F.col("id") % 4 == 0, 0.1).otherwise(0.9))
    return G.gap_clusters(nodes, GP._pairs(spark, d).select("src", "dst"), cutter(spark, "gap"))


@query("ana_pattern_hubs", f"WITH {GP.E03}, s AS (SELECT sum(weight) / (n.n * n.n) AS mean, sum(weight * weight) / (n.n * n.n) AS sq FROM both_ways, (SELECT count(*)::DOUBLE AS n FROM nodes) n GROUP BY n.n), t AS (SELECT mean + sqrt(sq - mean * mean) AS threshold FROM s) SELECT src AS id FROM (SELECT src, sum(weight) AS w FROM both_ways GROUP BY src), t WHERE w > threshold")
def ana_hubs(spark, d):
    return G.pattern_hubs(GP._cells(spark, d), GP._nodes(spark, d).count())


@query("ana_pipeline_ratios", f"WITH TAPES, {SP.SEGS}, e AS (SELECT doc_id, count(*) - 1 AS e FROM G GROUP BY doc_id), s AS (SELECT doc_id, count(*) AS n, avg((tag = 'KEEP')::INT) AS kept, count(*) FILTER (WHERE importance > 0.5) AS coh, string_agg(CASE WHEN tag = 'KEEP' THEN content END, {BREAK} ORDER BY id) AS after FROM G GROUP BY doc_id) SELECT T.doc_id, round(kept, 9) AS kept_ratio, round(length(after) / length(T.text), 9) AS compression, round(e / (n * n), 9) AS edge_density, e AS typed_edges, coh AS cohesive_segments FROM s JOIN T ON s.doc_id = T.doc_id JOIN e ON e.doc_id = s.doc_id")
def ana_ratios(spark, d):
    s = SP._segments(spark, d)
    after = s.filter("tag = 'KEEP'").groupBy("doc_id").agg(X.ordered_join(["id"], F.col("content"), X.BREAK).alias("after"))
    texts = tapes.transcripts(spark, d).withColumnRenamed("text", "before").join(after, "doc_id")
    r = G.pipeline_ratios(s.withColumn("cohesion", F.col("importance")), SP._chain(s), texts)
    return r.select("doc_id", *[F.round(c, 9).alias(c) for c in ("kept_ratio", "compression", "edge_density")], "typed_edges", "cohesive_segments")


LINES_TREE = GP.TREE.replace("FROM T)", "FROM L)")


@query("tree_preorder", f"WITH TAPES, {LINES_TREE}, k AS (SELECT * FROM tree WHERE level > 0 AND (has_code OR has_math)) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_id) - 1 AS k, seg_id, content FROM k")
def tree_preorder(spark, d):
    """The documents' tree, since transcripts hold neither code nor mathematics."""
    return AP._longs(G.preorder(R.build_tree(tapes.spaced_documents(spark, d), [S.paragraphs, GP.lines], one_rule_a_level=True)), "k")


@query("att_layer_stats", f"WITH {AP.ATTN}, b AS (SELECT layer, count(*) AS blocks FROM (SELECT DISTINCT window_idx, layer, head FROM attn) GROUP BY layer), h AS (SELECT layer, count(*) AS edges FROM attn WHERE w > 0.1 GROUP BY layer) SELECT b.layer::BIGINT AS layer, coalesce(edges, 0) AS edges, round(coalesce(edges, 0) / (blocks * 32 * 32), 9) AS density FROM b LEFT JOIN h ON b.layer = h.layer")
def att_layers(spark, d):
    return AP._longs(A.layer_stats(AP._attn(spark, d), 32).withColumn("density", F.round("density", 9)), "layer")


@query("att_top_edges", f"WITH {AP.ATTN}, m AS (SELECT window_idx, layer, i, j, round(avg(w), 9) AS w FROM attn WHERE i <> j GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY window_idx, layer ORDER BY w DESC, i, j) AS rank FROM m) SELECT window_idx, layer::BIGINT AS layer, rank, i, j, w FROM r WHERE rank <= 5")
def att_top_edges(spark, d):
    return AP._longs(A.top_edges(AP._attn(spark, d)), "layer", "rank", "i", "j").select("window_idx", "layer", "rank", "i", "j", "w")


@query("att_token_patterns", f"WITH {AP.ATTN} SELECT window_idx, round(avg(flow), 6) AS mean_flow, round(var_pop(flow), 6) AS flow_variance FROM flow GROUP BY window_idx")
def att_token_patterns(spark, d):
    return AP._flows(spark, d).groupBy("window_idx").agg(F.round(F.avg("flow"), 6).alias("mean_flow"), F.round(F.var_pop("flow"), 6).alias("flow_variance"))


@query("att_constrained", f"WITH {AP.ATTN}, b(t, bias) AS (VALUES {case_values(list(enumerate(G.EDGE_BIAS)))}), s AS (SELECT window_idx, head, i, j, d + coalesce(b.bias, 0)::DOUBLE - CASE WHEN (i + j) % 3 = 0 OR i = j THEN 0 ELSE 10000 END AS s FROM p LEFT JOIN b ON b.t = (i * j) % 10), xx AS (SELECT *, exp(s - max(s) OVER (PARTITION BY window_idx, head, i)) AS x FROM s) SELECT window_idx, head::BIGINT AS head, i, j, round(x / sum(x) OVER (PARTITION BY window_idx, head, i), 7) AS w FROM xx")
def att_constrained(spark, d):
    """Each head of a window is a window of its own to A.constrained."""
    place = F.floor(F.col("vec_id") / 32) * tapes.HEADS
    v = tapes.table(spark, d, "embeddings").select(F.explode(F.sequence(F.lit(0), F.lit(tapes.HEADS - 1))).alias("head"), place.alias("place"), (F.col("vec_id") % 32).alias("i"), "embedding")
    v = v.select((F.col("place") + F.col("head")).alias("window_idx"), "i", F.slice("embedding", F.col("head") * 32 + 1, F.lit(32)).alias("e"))
    pairs = v.join(v.withColumnsRenamed({"i": "j", "e": "f"}), "window_idx").select("window_idx", "i", "j", F.round(X.dot(F.col("e"), F.col("f")), 6).alias("s"))
    types = pairs.select("window_idx", "i", "j", (F.col("i") * F.col("j") % 10).cast("int").alias("edge_type"))
    adj = pairs.filter("(i + j) % 3 = 0 OR i = j")
    r = A.constrained(pairs, types, G.edge_type_dim(spark), adj)
    return r.select(F.floor(F.col("window_idx") / tapes.HEADS).alias("window_idx"), (F.col("window_idx") % tapes.HEADS).alias("head"), "i", "j", F.round("w", 7).alias("w"))


@query("att_adaptive_rank", "WITH s AS (SELECT vec_id AS id, unnest(list_reverse_sort(list_transform(embedding, lambda x: abs(x::DOUBLE)))) AS s, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT *, sum(s) OVER (PARTITION BY id ORDER BY k) AS c, sum(s) OVER (PARTITION BY id) AS t FROM s) SELECT id, greatest(4, least(40, min(k))) AS rank FROM c WHERE c >= t * 0.5 GROUP BY id")
def att_adaptive(spark, d):
    s = tapes.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.reverse(F.array_sort(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).alias("k", "s"))
    r = A.adaptive_rank(s.withColumn("k", F.col("k") + 1), 0.5, 4, 40)
    return AP._longs(r, "rank")


@query("att_path_switch", "SELECT doc_id, CASE WHEN n_chars > 1024 OR (doc_id % 10) / 10.0 > 0.3 THEN 'dual' ELSE 'standard' END AS path FROM documents")
def att_path(spark, d):
    return tapes.table(spark, d, "documents").select("doc_id", A.use_sparse_path(F.col("n_chars"), F.col("doc_id") % 10 / 10.0).alias("path"))


@query("seed_conversation", SP.seeds_sql(0.15, Y.MODES["speaker"], "<SEGMENT_RULE>"))
def seed_conversation(spark, d):
    return Y.seeded_conversation(tapes.transcripts(spark, d), "speaker")


@query("doc_generate", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, array_to_string(w[1:64], ' ') AS answer FROM w")
def doc_generate(spark, d):
    return M.generate(tapes.table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))).select("doc_id", "answer")


@query("doc_window_nodes", f"WITH TAPES, {PACK} SELECT doc_id, string_agg('## Step ' || (win_idx + 1) || ': semantic_chunk_' || win_idx || {BREAK} || chr(10) || text, {BREAK} ORDER BY win_idx) AS body FROM WN GROUP BY doc_id")
def doc_window_nodes(spark, d):
    """The older pipeline: windows as nodes of equal importance, reassembled as a tutorial."""
    w = _packed(spark, d)
    nodes = w.select("doc_id", F.concat(F.lit("semantic_chunk_"), F.col("win_idx").cast("string")).alias("id"), F.col("text").alias("content"), F.col("win_idx").alias("start_pos"), F.lit(1.0).alias("importance"), F.lit(False).alias("has_code"), F.lit(False).alias("has_math"), F.lit("KEEP").alias("tag"))
    return Y.reassemble(nodes, "tutorial").select("doc_id", F.regexp_replace("text", "^# Tutorial\n\n\n", "").alias("body"))


@query("doc_node_link", f"""WITH TAPES, {SP.SEGS}, {SP.CHAIN},
n AS (SELECT doc_id, string_agg('{{"id":"' || id || '","tag":"' || tag || '","content_length":' || length(content) || '}}', ',' ORDER BY id) AS n FROM G GROUP BY doc_id),
lk AS (SELECT doc_id, string_agg('{{"source":"' || src || '","target":"' || dst || '","weight":1.0}}', ',' ORDER BY src, dst) AS l FROM chain GROUP BY doc_id)
SELECT n.doc_id, '{{"nodes":[' || n || '],"links":[' || coalesce(l, '') || ']}}' AS json FROM n LEFT JOIN lk ON n.doc_id = lk.doc_id""")
def doc_node_link(spark, d):
    s = SP._segments(spark, d)
    return sinks.node_link(s, SP._chain(s))


@query(
    "doc_graph_summary",
    f"""WITH TAPES, {SP.SEGS}, {SP.CHAIN},
cut AS (SELECT doc_id, src, dst, 'CONTINUES' AS t FROM chain WHERE NOT src LIKE '%4'),
both_ways AS (SELECT doc_id, src, dst FROM cut UNION ALL SELECT doc_id, dst, src FROM cut),
reach AS (SELECT doc_id, id, id AS r FROM G UNION SELECT b.doc_id, b.src, reach.r FROM reach JOIN both_ways b ON b.doc_id = reach.doc_id AND b.dst = reach.id WHERE reach.r < b.src),
comps AS (SELECT doc_id, count(DISTINCT r) AS c FROM (SELECT doc_id, id, min(r) AS r FROM reach GROUP BY ALL) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS edges, 'CONTINUES=' || count(*) AS edge_types FROM cut GROUP BY doc_id),
tg AS (SELECT doc_id, string_agg(tag || '=' || c, ',' ORDER BY tag) AS tags, sum(c)::BIGINT AS segments FROM (SELECT doc_id, tag, count(*) AS c FROM G GROUP BY ALL) GROUP BY doc_id)
SELECT tg.doc_id, segments, coalesce(edges, 0) AS edges, tags, coalesce(edge_types, '') AS edge_types, comps.c = 1 AS connected FROM tg JOIN comps ON tg.doc_id = comps.doc_id LEFT JOIN e ON e.doc_id = tg.doc_id""",
)
def doc_graph_summary(spark, d):
    """Chains without some links, so that some of the graphs fall apart."""
    s = SP._segments(spark, d)
    r = sinks.graph_summary(s, SP._chain(s).filter("NOT src LIKE '%4'"), G.edge_type_dim(spark), cutter(spark, "summary"))
    shown = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["name"], F.lit("="), e["n"].cast("string"))), ",")
    return r.select("doc_id", "segments", "edges", shown(F.col("tags")).alias("tags"), shown(F.col("edge_types")).alias("edge_types"), "connected")


@query(
    "het_synthetic_edges",
    """WITH n AS (SELECT count(*) AS n FROM part), i AS (SELECT unnest(range((SELECT greatest(10, n) FROM n))) AS i),
w AS (SELECT i AS src, i % greatest(1, n) AS dst FROM i, n WHERE i < least(greatest(10, n // 10), n)), t AS (SELECT i AS src, i % greatest(5, n // 20) AS dst FROM i, n WHERE i < least(greatest(5, n // 20), n))
SELECT 'writes' AS relation, src, dst FROM w UNION ALL SELECT 'written_by', dst, src FROM w UNION ALL SELECT 'has_topic', src, dst FROM t UNION ALL SELECT 'topic_of', dst, src FROM t""",
)
def het_synthetic(spark, d):
    made = H.synthetic_relations(spark, tapes.table(spark, d, "part").count())
    rows = [df.select(F.lit(name).alias("relation"), "src", "dst") for (_, name, _), df in made.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("het_cached_fetch", "SELECT o_orderkey AS place, o_custkey AS id, coalesce(o_custkey % 2 = 0 AND c_custkey IS NOT NULL, false) AS from_cache, CASE WHEN o_custkey % 2 = 0 THEN -c_acctbal ELSE c_acctbal END AS balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def het_cached(spark, d):
    """Even customers come from a cache whose balances are negated, so that it shows where a row is from."""
    store = tapes.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    cache = store.filter("id % 2 = 0").withColumn("balance", -F.col("balance"))
    return H.cached_fetch(cache, store, tapes.table(spark, d, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("id")))


@query("vec_hashed_embedding")
def vec_hashed(spark, d):
    return tapes.table(spark, d, "documents").select("doc_id", F.transform(M.hashed_embedding(F.col("text"), 32), lambda x: F.round(x, 6)).alias("embedding"))

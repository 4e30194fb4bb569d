"""Queries: two-level attention, its aggregates and segments, and the operators around complete trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import models as M
from loomspark.functions import text as X
from loomspark.operators import align as L
from loomspark.operators import attention as A
from loomspark.operators import graph as G
from loomspark.operators import segment as S
from loomspark.operators import synth as Y
from loomspark.operators import text_attention as TA
from loomspark.operators import tree as R
from loomspark.operators import vectors as V
from loomspark.plans import attention_plans as AP
from loomspark.plans import graph_plans as GP
from loomspark.plans import synthesis_plans as SP
from loomspark.plans.registry import query
from loomspark.plans.text_plans import FENCED, PARAS, STRIP, fenced
from loomspark.sources import tapes
from loomspark.sources.scratch import cutter

CROSS = "ct AS (SELECT m.window_idx, m.i AS tok, b.seg AS node, avg(w) AS w FROM mean m JOIN map b ON m.window_idx = b.window_idx AND m.j = b.tok GROUP BY ALL)"


def _cross(spark, d):
    m = AP._mapping(spark, d).select("window_idx", F.col("tok").alias("j"), F.col("seg").alias("node"))
    return AP._mean(spark, d).join(m, ["window_idx", "j"]).groupBy("window_idx", F.col("i").alias("tok"), "node").agg(F.avg("w").alias("w"))


def _node_sizes(spark, d):
    return AP._mapping(spark, d).groupBy("window_idx").agg(F.count_distinct("seg").cast("long").alias("n"))


CROSS_SUMMARY = f"""{AP.MAPPED}, {CROSS},
st AS (SELECT window_idx, avg(w) AS mean, max(w) AS most, count(DISTINCT node) AS nodes FROM ct GROUP BY window_idx),
mx AS (SELECT window_idx, avg(m) AS strength FROM (SELECT window_idx, tok, max(w) AS m FROM ct GROUP BY ALL) GROUP BY window_idx),
ow AS (SELECT window_idx, sum(a) AS a FROM (SELECT ct.window_idx, node, avg(w) AS a, count(*) AS c FROM ct JOIN map ON map.window_idx = ct.window_idx AND map.tok = ct.tok AND map.seg = ct.node GROUP BY ALL) WHERE c > 1 GROUP BY window_idx),
cs AS (SELECT st.window_idx, mean, most, coalesce(a, 0.0) / nodes AS consistency, strength FROM st JOIN mx ON mx.window_idx = st.window_idx LEFT JOIN ow ON ow.window_idx = st.window_idx)"""


@query("att_cross_summary", f"WITH {CROSS_SUMMARY} SELECT window_idx, round(mean, 6) AS mean, round(most, 6) AS most, round(consistency, 6) AS consistency, round(strength, 6) AS strength FROM cs")
def att_cross_summary(spark, d):
    r = A.cross_summary(_cross(spark, d), AP._mapping(spark, d))
    return r.select("window_idx", *[F.round(c, 6).alias(c) for c in ("mean", "most", "consistency", "strength")])


COHESIONS = """cs_s AS (SELECT m.window_idx, a.seg, sum(CASE WHEN a.seg = b.seg THEN w ELSE 0 END) AS inn, sum(CASE WHEN a.seg <> b.seg THEN w ELSE 0 END) AS outt FROM mean m JOIN map a ON m.window_idx = a.window_idx AND m.i = a.tok JOIN map b ON m.window_idx = b.window_idx AND m.j = b.tok GROUP BY ALL),
cs_r AS (SELECT s.window_idx, inn / (k * k) AS internal, CASE WHEN n > k THEN outt / (k * (n - k)) END AS external FROM cs_s s JOIN sizes z ON s.window_idx = z.window_idx AND s.seg = z.seg JOIN size ON size.window_idx = s.window_idx WHERE k >= 2),
co AS (SELECT window_idx, avg(c) AS overall, var_pop(c) AS variance, min(c) AS least, max(c) AS most FROM (SELECT window_idx, CASE WHEN external IS NULL THEN internal ELSE internal / (external + 1e-6) END AS c FROM cs_r) GROUP BY window_idx)"""


@query("att_cohesion_summary", f"WITH {AP.MAPPED}, {COHESIONS} SELECT window_idx, round(overall, 6) AS overall, round(variance, 6) AS variance, round(least, 6) AS least, round(most, 6) AS most FROM co")
def att_cohesion_summary(spark, d):
    r = A.cohesion_summary(A.cohesion(AP._mean(spark, d), AP._mapping(spark, d)))
    return r.select("window_idx", *[F.round(c, 6).alias(c) for c in ("overall", "variance", "least", "most")])


# patterns over token cells: those under 0.03 count as absent, so that some neighbours are no neighbours of each other
PATTERNS = """pc AS MATERIALIZED (SELECT window_idx, i, j, w FROM mean WHERE round(w, 7) > 0.03),
ps AS (SELECT z.window_idx, z.n, coalesce(sum(w), 0.0) / (z.n * z.n) AS mean, coalesce(sum(w * w), 0.0) / (z.n * z.n) AS sq, count(w) / (z.n * z.n) AS density FROM size z LEFT JOIN pc ON pc.window_idx = z.window_idx GROUP BY z.window_idx, z.n),
pt AS (SELECT *, greatest(sq - mean * mean, 0) AS variance, mean + sqrt(greatest(sq - mean * mean, 0)) AS threshold FROM ps),
ph AS (SELECT window_idx, count(DISTINCT id) AS hubs FROM (SELECT window_idx, i AS id, sum(w) AS s FROM pc GROUP BY ALL UNION ALL SELECT window_idx, j, sum(w) FROM pc GROUP BY ALL) JOIN pt USING (window_idx) WHERE s > threshold GROUP BY window_idx),
pk AS (SELECT window_idx, i, count(*) AS k FROM pc GROUP BY ALL HAVING count(*) >= 2),
pcl AS (SELECT a.window_idx, a.i, count(*) AS closed FROM pc a JOIN pc b ON a.window_idx = b.window_idx AND a.i = b.i AND a.j <> b.j JOIN pc e ON e.window_idx = a.window_idx AND e.i = a.j AND e.j = b.j GROUP BY ALL),
pm AS (SELECT pk.window_idx, avg(coalesce(closed, 0) / (k * (k - 1))) AS clustering FROM pk LEFT JOIN pcl ON pk.window_idx = pcl.window_idx AND pk.i = pcl.i JOIN size ON size.window_idx = pk.window_idx AND size.n >= 3 GROUP BY pk.window_idx),
pe AS MATERIALIZED (SELECT pc.window_idx, i, j FROM pc JOIN pt ON pt.window_idx = pc.window_idx WHERE w > threshold),
pb AS MATERIALIZED (SELECT window_idx, i AS a, j AS b FROM pe UNION SELECT window_idx, j, i FROM pe),
pr AS (SELECT window_idx, i AS id, i AS r FROM v UNION SELECT pb.window_idx, pb.a, pr.r FROM pr JOIN pb ON pb.window_idx = pr.window_idx AND pb.b = pr.id WHERE pr.r < pb.a),
pp AS (SELECT window_idx, count(*) AS components, max(c) AS largest FROM (SELECT window_idx, r, count(*) AS c FROM (SELECT window_idx, id, min(r) AS r FROM pr GROUP BY ALL) GROUP BY ALL) GROUP BY window_idx),
pa AS (SELECT pt.window_idx, n AS nodes, mean, variance, coalesce(hubs, 0) AS hubs, coalesce(clustering, 0.0) AS clustering, components, largest, density FROM pt LEFT JOIN ph ON ph.window_idx = pt.window_idx LEFT JOIN pm ON pm.window_idx = pt.window_idx JOIN pp ON pp.window_idx = pt.window_idx)"""


def _patterns(spark, d):
    cells = AP._mean(spark, d).filter(F.round("w", 7) > 0.03).withColumns({c: F.col(c).cast("long") for c in "ij"})
    return G.node_patterns(cells, AP._sizes(spark, d), cutter(spark, "patterns"))


@query("ana_node_patterns", f"WITH RECURSIVE {AP.ATTN}, {PATTERNS} SELECT window_idx, nodes, round(mean, 7) AS mean, round(variance, 7) AS variance, hubs, round(clustering, 7) AS clustering, components, largest, round(density, 7) AS density FROM pa")
def ana_patterns(spark, d):
    r = _patterns(spark, d)
    return r.select("window_idx", "nodes", "hubs", "components", "largest", *[F.round(c, 7).alias(c) for c in ("mean", "variance", "clustering", "density")])


@query(
    "att_dual_results",
    f"""WITH RECURSIVE {AP.FOUND}, {AP.MERGED}, map AS (SELECT window_idx, i AS tok, i // 8 AS seg FROM v), sizes AS (SELECT window_idx, seg, count(*) AS k, min(tok) AS first, max(tok) AS last FROM map GROUP BY ALL), {PATTERNS}, {CROSS_SUMMARY[len(AP.MAPPED) + 2:]}, {COHESIONS}
SELECT round(avg(pa.mean), 6) AS mean_node_attention, round(avg(clustering), 6) AS mean_clustering, round(avg(density), 6) AS mean_density, coalesce(sum(hubs), 0)::BIGINT AS total_hubs, round(avg(largest), 6) AS avg_component_size, count(*) AS windows_processed,
  (SELECT round(avg(mean), 6) FROM cs) AS mean_cross_attention, (SELECT round(avg(consistency), 6) FROM cs) AS mean_consistency, (SELECT round(avg(strength), 6) FROM cs) AS mean_strength, (SELECT count(*) > 0 FROM cs) AS has_cross_attention,
  (SELECT round(avg(overall), 6) FROM co) AS mean_cohesion, (SELECT round(var_pop(overall), 6) FROM co) AS cohesion_variance, (SELECT round(min(overall), 6) FROM co) AS min_cohesion, (SELECT round(max(overall), 6) FROM co) AS max_cohesion,
  (SELECT count(*) FROM merged) AS dual_boundary_count, count(*) > 0 AS has_node_attention FROM pa""",
)
def att_dual(spark, d):
    """The whole two-level analysis: patterns, cross-level attention, cohesion and merged boundaries, over all windows."""
    r = A.dual_results(_patterns(spark, d), A.cross_summary(_cross(spark, d), AP._mapping(spark, d)), A.cohesion_summary(A.cohesion(AP._mean(spark, d), AP._mapping(spark, d))), AP._merged(spark, d))
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


@query("att_window_patterns", f"WITH {AP.ATTN}, {AP.ENTROPY}, q AS (SELECT window_idx, i, j, round(sum(w) / 2, 9) AS w FROM cells GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY window_idx ORDER BY w DESC, i, j) AS rank FROM q), p AS (SELECT window_idx, string_agg(i || '>' || j, ',' ORDER BY rank) AS paths FROM r WHERE rank <= 3 GROUP BY window_idx) SELECT e.window_idx, list(round(entropy, 6) ORDER BY layer) AS entropies, round(1 / (1 + var_pop(entropy)), 6) AS coherence, any_value(paths) AS paths FROM ent e JOIN p ON p.window_idx = e.window_idx GROUP BY e.window_idx".replace(", p AS (SELECT window_idx, string_agg", ", pth AS (SELECT window_idx, string_agg").replace("JOIN p ON p.window_idx", "JOIN pth ON pth.window_idx"))
def att_window_patterns(spark, d):
    r = A.window_patterns(AP._attn(spark, d), AP._sizes(spark, d), tapes.HEADS, tapes.LAYERS)
    paths = F.array_join(F.transform("paths", lambda p: F.concat(p["i"].cast("string"), F.lit(">"), p["j"].cast("string"))), ",")
    return r.select("window_idx", F.transform("entropies", lambda e: F.round(e, 6)).alias("entropies"), F.round("coherence", 6).alias("coherence"), paths.alias("paths"))


@query("att_picked_layers", f"WITH {AP.ATTN}, l AS (SELECT 'first' AS view, 0 AS layer UNION ALL SELECT 'middle', 1 UNION ALL SELECT 'last', 1) SELECT view, window_idx, head::BIGINT AS head, i, j, w FROM attn JOIN l ON l.layer = attn.layer")
def att_picked(spark, d):
    return AP._longs(A.picked_layers(AP._attn(spark, d)), "head", "i", "j")


@query("att_graph_edges", f"WITH {AP.ATTN} SELECT window_idx * 32 + i AS src, window_idx * 32 + j AS dst, round(w, 9) AS weight FROM mean WHERE round(w, 9) > 0.045")
def att_graph_edges(spark, d):
    place = lambda c: (F.col("window_idx") * 32 + F.col(c)).alias(c)
    return G.attention_edges(AP._mean(spark, d).select(place("i"), place("j"), F.round("w", 9).alias("w")), 0.045)


@query("graph_dual_adjacency", f"WITH {AP.MAPPED}, {AP.NODES}, s AS (SELECT i, j, sum(w) / (SELECT count(*) FROM size) AS w FROM node GROUP BY ALL), t AS (SELECT sum(w) / 16 + sqrt(greatest(sum(w * w) / 16 - pow(sum(w) / 16, 2), 0)) AS t FROM s) SELECT i, j, round(w, 9) AS w, w > t AS linked FROM s, t")
def graph_dual_adjacency(spark, d):
    r = G.dual_adjacency(AP._node_cells(spark, d), AP._sizes(spark, d).count(), 4)
    return AP._longs(r.withColumn("w", F.round("w", 9)), "i", "j")


@query("graph_node_strengths", f"WITH {AP.MAPPED}, {AP.NODES}, st AS (SELECT window_idx, i, sum(w) / 4 AS strength FROM node GROUP BY ALL) SELECT window_idx * 4 + i AS id, round(strength, 7) AS strength, 0.0::DOUBLE AS cohesion FROM st WHERE round(strength, 7) > 0.03")
def graph_strengths(spark, d):
    cells = AP._node_cells(spark, d).select((F.col("window_idx") * 4 + F.col("i")).alias("i"), "j", "w")
    rows = G.node_strengths(cells.select("i").distinct(), cells, 4).withColumn("strength", F.round("strength", 7))
    return G.gap_hubs(rows.withColumnRenamed("i", "id"), 0.03)


@query("graph_cross_agreement", f"WITH {GP.E03} SELECT round(avg(CASE WHEN src % 2 = 0 THEN weight ELSE 0 END), 9) AS agreement FROM edges")
def graph_agreement(spark, d):
    r = G.cross_level_agreement(GP._pairs(spark, d).withColumn("agreement", F.when(F.col("src") % 2 == 0, F.col("weight"))))
    return r.select(F.round("agreement", 9).alias("agreement"))


@query(
    "att_head_simplices",
    f"""WITH {AP.ATTN}, hm AS (SELECT window_idx * 2 + head AS g, i, j, avg(w) AS w FROM attn GROUP BY ALL), s AS (SELECT g, i, j, sum(w) / 2 AS w FROM (SELECT * FROM hm UNION ALL SELECT g, j, i, w FROM hm) GROUP BY ALL),
e AS MATERIALIZED (SELECT g, i AS a, j AS b FROM s WHERE round(w, 7) > 0.045 AND i < j),
t AS MATERIALIZED (SELECT x.g, x.a, x.b, y.b AS c FROM e x JOIN e y ON y.g = x.g AND x.b = y.a JOIN e z ON z.g = x.g AND z.a = x.a AND z.b = y.b),
q AS (SELECT t.g, t.a, t.b, t.c, p.b AS d FROM t JOIN e p ON p.g = t.g AND p.a = t.a JOIN e q ON q.g = t.g AND q.a = t.b AND q.b = p.b JOIN e r ON r.g = t.g AND r.a = t.c AND r.b = p.b),
o AS (SELECT DISTINCT g, 0::BIGINT AS dim, [i] AS members FROM s UNION ALL SELECT g, 1, [a, b] FROM e UNION ALL SELECT g, 2, [a, b, c] FROM t UNION ALL SELECT g, 3, [a, b, c, d] FROM q)
SELECT g // 2 AS window_idx, g % 2 AS head, dim, members FROM o""",
)
def att_head_simplices(spark, d):
    """Each head of a window, after its layers' mean, is a graph by itself."""
    cells = AP._attn(spark, d).groupBy((F.col("window_idx") * tapes.HEADS + F.col("head")).alias("g"), "i", "j").agg(F.avg("w").alias("w"))
    r = G.simplices(cells, 32, 0.045, "g")
    return AP._longs(r.select(F.floor(F.col("g") / tapes.HEADS).alias("window_idx"), (F.col("g") % tapes.HEADS).alias("head"), "dim", "members"), "head", "dim")


@query("att_spectra_rank")
def att_spectra_rank(spark, d):
    """Ranks that keep half of each matrix's singular mass."""
    s = A.spectra(AP._attn(spark, d))
    ids = s.withColumn("id", (F.col("window_idx") * tapes.LAYERS + F.col("layer")) * tapes.HEADS + F.col("head"))
    return A.adaptive_rank(ids.select("id", "k", "s"), 0.5, 1, 32)


@query("att_blockwise")
def att_blockwise(spark, d):
    v = tapes.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 128).alias("window_idx"), (F.col("vec_id") % 128).alias("i"), F.col("embedding").alias("vec"))
    return A.blockwise_attention(v, tapes.HEADS).withColumn("out", F.transform("out", lambda x: F.round(x, 6)))


@query("att_constrained_low_rank")
def att_constrained_low(spark, d):
    """Scores of both heads with bias and mask, at full rank the mean over heads of att_constrained."""
    return A.constrained_low_rank(_head_scores(spark, d), 0.3).withColumn("w", F.round("w", 6))


def _head_scores(spark, d):
    half = tapes.WINDOW
    v = tapes.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 32).alias("window_idx"), F.explode(F.sequence(F.lit(0), F.lit(tapes.HEADS - 1))).alias("head"), (F.col("vec_id") % 32).alias("i"), "embedding")
    v = v.select("window_idx", "head", "i", F.slice("embedding", F.col("head") * half + 1, F.lit(half)).alias("e"))
    pairs = v.join(v.withColumnsRenamed({"i": "j", "e": "f"}), ["window_idx", "head"]).select("window_idx", "head", "i", "j", F.round(X.dot(F.col("e"), F.col("f")), 6).alias("s"))
    types = pairs.select("window_idx", "head", "i", "j", (F.col("i") * F.col("j") % 10).cast("int").alias("edge_type"))
    return A.constrained_scores(pairs, types, G.edge_type_dim(spark), pairs.filter("(i + j) % 3 = 0 OR i = j"), ["window_idx", "head"])


# attention between the words of a transcript: equal words within a band, in two layers (16 and 64 back) and two heads (the word, and it with its neighbours)
TEXT_ATTN = r"""tw AS (SELECT doc_id, regexp_split_to_array(text, '\s') AS ws FROM T), te AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM tw),
tx AS (SELECT doc_id, w, i, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM te),
tn AS MATERIALIZED (SELECT doc_id, lower(w) AS w, b, b + length(w) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM tx WHERE w <> ''),
tz AS (SELECT doc_id, count(*) AS n FROM tn GROUP BY doc_id),
eq AS MATERIALIZED (SELECT a.doc_id, a.k AS i, b.k AS j FROM tn a JOIN tn b ON a.doc_id = b.doc_id AND a.w = b.w AND b.k < a.k AND a.k - b.k <= 64),
hs AS (SELECT doc_id, 0 AS head, i, j, 1.0::DOUBLE AS s FROM eq
  UNION ALL SELECT doc_id, 1, i, j, c / 3.0::DOUBLE FROM (SELECT doc_id, i + d AS i, j + d AS j, count(*) AS c FROM eq, (VALUES (-1), (0), (1)) r(d) GROUP BY ALL) JOIN tz USING (doc_id) WHERE j >= 0 AND i < n),
la AS (SELECT *, 0 AS layer FROM hs WHERE i - j <= 16 UNION ALL SELECT *, 1 AS layer FROM hs),
ta AS MATERIALIZED (SELECT doc_id, layer, head, i, j, s / (1 + sum(s) OVER (PARTITION BY doc_id, layer, head, i)) AS w FROM la)"""

TEXT_FLOW = f"""{TEXT_ATTN},
tf AS (SELECT doc_id, k AS i, round(coalesce(f, 0), 9) AS flow FROM tn LEFT JOIN (SELECT doc_id, i AS k, sum(w * (1 + layer / 2.0)) / 5 AS f FROM ta GROUP BY ALL) USING (doc_id, k)),
tl AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, avg(flow) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prev,
  avg(flow) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM tf),
tb AS (SELECT doc_id, i AS position, round(1 - flow / prev, 9) AS strength, 'attention_drop' AS type FROM tl WHERE i >= 3 AND i <= n - 2 AND prev > 0 AND flow / prev < 1 - 0.3
  UNION ALL SELECT doc_id, i, round(flow / near - 1, 9), 'attention_peak' FROM tl WHERE i >= 1 AND i <= n - 4 AND near > 0 AND flow > near * (1 + 0.3)),
tc AS (SELECT doc_id, position, avg(strength) AS strength, min(type) AS type, count(*) AS n FROM tb GROUP BY ALL HAVING avg(strength) > 0.2)"""


@query("att_text_flow", f"WITH TAPES, {TEXT_FLOW} SELECT doc_id, i, round(flow, 6) AS flow FROM tf")
def att_text_flow(spark, d):
    """Attention flow over the words of every transcript."""
    tokens = TA.tokens_of(tapes.transcripts(spark, d))
    return TA.text_flow(TA.banded_attention(tokens, ordered=True), tokens).withColumn("flow", F.round("flow", 6))


@query("att_text_boundaries", f"WITH TAPES, {TEXT_FLOW} SELECT doc_id, position, round(strength, 6) AS strength, type, n FROM tc")
def att_text_boundaries(spark, d):
    tokens = TA.tokens_of(tapes.transcripts(spark, d))
    return TA.text_boundaries(TA.text_flow(TA.banded_attention(tokens, ordered=True), tokens)).withColumn("strength", F.round("strength", 6))


@query(
    "seg_by_attention",
    f"""WITH TAPES, {TEXT_FLOW}, tp AS (SELECT tn.doc_id, b AS pos FROM tn JOIN tc ON tn.doc_id = tc.doc_id AND tn.k = tc.position WHERE b > 0 UNION SELECT doc_id, 0 FROM T),
ts AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM tp),
pc AS (SELECT T.doc_id, pos, trim(substring(text, pos + 1, coalesce(nx, length(text)) - pos), {STRIP}) AS content FROM ts JOIN T ON T.doc_id = ts.doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord, pos AS start_pos, content FROM pc WHERE content <> ''""",
)
def seg_by_attention(spark, d):
    """Transcripts cut where their own attention drops or peaks."""
    return AP._longs(TA.segment_by_attention(tapes.transcripts(spark, d)), "ord", "start_pos")


# pieces at their places in the text, and token attention pooled to them
DUAL = f"""{TEXT_ATTN}, {PARAS.format(tape='T')},
pb AS (SELECT doc_id, i, raw, coalesce(sum(length(raw) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(ltrim(raw, {STRIP})) AS b FROM P0),
po AS MATERIALIZED (SELECT P.doc_id, row_number() OVER (PARTITION BY P.doc_id ORDER BY P.i) - 1 AS ord, content, b, b + length(content) AS e FROM P JOIN pb ON P.doc_id = pb.doc_id AND P.i = pb.i),
tm AS MATERIALIZED (SELECT tn.doc_id, k, max(ord) AS seg FROM tn JOIN po ON tn.doc_id = po.doc_id AND tn.b < po.e AND tn.e > po.b GROUP BY ALL),
sk AS (SELECT doc_id, seg, count(*) AS k FROM tm GROUP BY ALL),
nd AS (SELECT ta.doc_id, layer, x.seg AS i, y.seg AS j, sum(w) AS w FROM ta JOIN tm x ON x.doc_id = ta.doc_id AND x.k = ta.i JOIN tm y ON y.doc_id = ta.doc_id AND y.k = ta.j GROUP BY ALL),
nw AS (SELECT nd.doc_id, i, j, round(sum(w / (x.k * y.k * 2)), 9) AS w FROM nd JOIN sk x ON x.doc_id = nd.doc_id AND x.seg = i JOIN sk y ON y.doc_id = nd.doc_id AND y.seg = j GROUP BY ALL),
nn AS (SELECT doc_id, count(*) AS n FROM po GROUP BY doc_id),
nt AS (SELECT doc_id, round(sum(w) / (max(n) * max(n)) + sqrt(greatest(sum(w * w) / (max(n) * max(n)) - (sum(w) / (max(n) * max(n))) * (sum(w) / (max(n) * max(n))), 0)), 9) AS t FROM nw JOIN nn USING (doc_id) GROUP BY doc_id),
ng AS (SELECT nw.doc_id, i, j, w, w > t AS linked FROM nw JOIN nt USING (doc_id))"""


@query("seg_dual_edges", f"WITH TAPES, {DUAL} SELECT doc_id, i, j, round(w, 6) AS weight, linked FROM ng")
def seg_dual_edges(spark, d):
    _, graph = TA.segment_with_dual_attention(tapes.transcripts(spark, d))
    return AP._longs(graph.withColumn("weight", F.round("weight", 6)), "i", "j")


@query("seg_dual", f"WITH TAPES, {DUAL}, ls AS (SELECT doc_id, i AS ord, string_agg(j::VARCHAR, ',' ORDER BY j) AS links FROM ng WHERE linked AND i <> j GROUP BY ALL) SELECT po.doc_id, po.ord, content, coalesce(sum(length(content) + 1) OVER w, 0)::BIGINT AS start_pos, (coalesce(sum(length(content) + 1) OVER w, 0) + length(content))::BIGINT AS end_pos, coalesce(links, '') AS links FROM po LEFT JOIN ls ON ls.doc_id = po.doc_id AND ls.ord = po.ord WINDOW w AS (PARTITION BY po.doc_id ORDER BY po.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def seg_dual(spark, d):
    """Pieces with their places and the pieces that two-level attention links them to."""
    pieces, _ = TA.segment_with_dual_attention(tapes.transcripts(spark, d))
    return AP._longs(pieces.withColumn("links", F.array_join("links", ",")), "ord", "start_pos", "end_pos")


@query("tok_segment_mask", f"WITH {AP.TOKENS} SELECT doc_id, tok_idx, ntile(7) OVER (PARTITION BY doc_id ORDER BY tok_idx) - 1 = 3 AS in_segment FROM tk")
def tok_mask(spark, d):
    return AP._longs(L.segment_mask(L.uniform_map(AP._tokens(spark, d), 7), 3).select("doc_id", "tok_idx", "in_segment"), "tok_idx")


@query("tok_multi_level", f"WITH {AP.TOKENS} SELECT doc_id, tok_idx, '0=' || (ntile(4) OVER w - 1) || ',1=' || (ntile(8) OVER w - 1) AS levels FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)")
def tok_levels(spark, d):
    shown = F.array_join(F.transform(F.map_entries("levels"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    return AP._longs(L.uniform_levels(AP._tokens(spark, d), [4, 8]).select("doc_id", "tok_idx", shown.alias("levels")), "tok_idx")


@query("vec_dual", f"WITH {GP.FLAT}, m AS (SELECT label, dim, avg(x) AS mean FROM flat WHERE vec_id % 5 <> 0 GROUP BY ALL) SELECT f.vec_id, f.dim, round(f.x, 6) AS own, CASE WHEN f.vec_id % 5 <> 0 THEN round(m.mean, 6) END AS node FROM flat f JOIN m ON f.label = m.label AND f.dim = m.dim")
def vec_dual(spark, d):
    """Every fifth vector has no node."""
    e = tapes.table(spark, d, "embeddings")
    mapping = e.select(F.col("vec_id").alias("tok"), F.when(F.col("vec_id") % 5 != 0, F.col("label")).alias("seg"))
    r = V.dual_embeddings(e.select(F.col("vec_id").alias("tok"), F.col("embedding").alias("vec")), mapping)
    flat = r.select(F.col("tok").alias("vec_id"), F.posexplode("vec").alias("dim", "own"), "node_vec")
    return flat.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("own").cast("double"), 6).alias("own"), F.round(F.get("node_vec", F.col("dim")), 6).alias("node"))


@query("vec_keyword_overlap", r"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM conversations), n AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM w) SELECT conv_id, turn, least(len(list_intersect(list_distinct(p[greatest(len(p) - 99, 1) : len(p)]), list_distinct(w[1:50]))) / 10.0, 0.3)::DOUBLE AS overlap FROM n WHERE p IS NOT NULL")
def vec_overlap(spark, d):
    from pyspark.sql import Window

    rows = tapes.table(spark, d, "conversations").withColumn("p", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("p IS NOT NULL")
    return rows.select("conv_id", "turn", X.keyword_overlap(F.col("p"), F.col("text")).alias("overlap"))


# fixed values: as the opening phrases of guided documents
@query(
    "doc_formatted",
    f"""WITH TAPES, {SP.SEGS}, c AS (SELECT doc_id, id, segment_type AS k, content, CASE WHEN regexp_extract(content, '\\*\\*(.+?)\\*\\*', 1) <> '' THEN regexp_extract(content, '\\*\\*(.+?)\\*\\*', 1) WHEN length(trim(split_part(content, '.', 1), {STRIP})) < 100 THEN trim(split_part(content, '.', 1), {STRIP}) END AS concept FROM (SELECT * REPLACE (CASE WHEN start_pos % 5 = 4 THEN 'example' ELSE segment_type END AS segment_type) FROM G)),
f AS (SELECT doc_id, id, k, CASE WHEN contains(content, '```') OR contains(content, 'def ') OR contains(content, 'class ') OR contains(content, 'function ') OR contains(content, 'import ') THEN content WHEN k = 'example' THEN '*Example:*' || chr(10) || content WHEN k = 'foundational' AND concept <> '' THEN '**' || concept || '**' || chr(10) || chr(10) || content ELSE content END AS text FROM c)
SELECT doc_id, id, text, chr(10) || CASE WHEN k = 'example' THEN 'To illustrate this concept:' WHEN k = 'technical_core' THEN 'From a technical perspective:' WHEN contains(lower(text), 'however') THEN 'However, it''s important to note:' WHEN contains(lower(text), 'question') THEN 'This raises an important question:' ELSE 'Furthermore:' END || chr(10) AS opening FROM f""",
)
def doc_formatted(spark, d):
    s = SP._segments(spark, d).withColumn("kind", F.when(F.col("start_pos") % 5 == 4, "example").otherwise(F.col("segment_type")))
    rows = s.select("doc_id", "id", "kind", Y.formatted(F.col("kind"), F.col("content"), X.key_concept(F.col("content"))).alias("text"))
    return rows.select("doc_id", "id", "text", Y.opening(F.col("kind"), F.col("text")).alias("opening"))


@query("graph_relations", "SELECT a.conv_id, a.turn, CASE WHEN length(a.text) > length(b.text) THEN 'explains' WHEN length(a.text) < length(b.text) THEN 'elaborates' ELSE 'unknown' END AS relation FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def graph_relations(spark, d):
    """A stand-in model that goes by the texts' lengths."""
    c = tapes.table(spark, d, "conversations")
    pairs = c.select("conv_id", "turn", F.col("text").alias("a_text")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b_text")), ["conv_id", "turn"])
    by_length = lambda a, b: ["explains" if len(x) > len(y) else "elaborates" if len(x) < len(y) else "same" for x, y in zip(a, b)]
    return M.classify_pairs(pairs, by_length, most=1 << 30).select("conv_id", "turn", "relation")


@query("graph_upsert", "WITH e AS (SELECT o_custkey AS src, o_orderkey % 7 AS dst, o_orderkey AS at_order FROM orders) SELECT src, dst, max(at_order) AS at_order FROM e GROUP BY src, dst")
def graph_upsert(spark, d):
    e = tapes.table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 7).alias("dst"), F.col("o_orderkey").alias("at_order"))
    return G.upsert_edges(e, "at_order")


@query("tree_pending", f"WITH TAPES, {GP.TREE} SELECT doc_id, seg_id FROM tree WHERE NOT atomic AND NOT (level = 0 OR (level = 1 AND ord % 2 = 0))")
def tree_pending(spark, d):
    """Rule 0 has processed roots and their children, rule 1 roots and every other child."""
    t = GP._tree(spark, d)
    one = t.filter("level <= 1").select("doc_id", "seg_id", F.lit(0).alias("rule_idx"))
    two = t.filter("level = 0 OR (level = 1 AND ord % 2 = 0)").select("doc_id", "seg_id", F.lit(1).alias("rule_idx"))
    return R.OpenTree(t).pending(one.unionByName(two), 2).select("doc_id", "seg_id")


SEMANTIC = "s AS (SELECT doc_id, seg_id AS src, lead(seg_id) OVER (PARTITION BY doc_id ORDER BY seg_id) AS dst FROM tree), k AS (SELECT doc_id, least(parent_id, seg_id) AS lo, greatest(parent_id, seg_id) AS hi FROM tree WHERE parent_id IS NOT NULL), se AS (SELECT s.doc_id, src, dst FROM s LEFT JOIN k ON k.doc_id = s.doc_id AND k.lo = least(src, dst) AND k.hi = greatest(src, dst) WHERE dst IS NOT NULL AND k.lo IS NULL)"


@query("tree_semantic_edges", f"WITH TAPES, {GP.TREE}, {SEMANTIC} SELECT doc_id, src, dst, 0.5::DOUBLE AS weight, 'semantic_similarity' AS type FROM se")
def tree_semantic(spark, d):
    """Each segment to the next in pre-order, unless one is the other's parent."""
    from pyspark.sql import Window

    t = GP._tree(spark, d)
    pairs = t.select("doc_id", F.col("seg_id").alias("src"), F.lead("seg_id").over(Window.partitionBy("doc_id").orderBy("seg_id")).alias("dst"), F.lit(0.5).alias("weight")).filter("dst IS NOT NULL")
    return R.OpenTree(t).complete().semantic_edges(pairs)


@query("tree_sequential_edges", f"WITH TAPES, {GP.TREE}, s AS (SELECT doc_id, seg_id AS src, lead(seg_id) OVER (PARTITION BY doc_id, parent_id ORDER BY start_pos, seg_id) AS dst FROM tree WHERE parent_id IS NOT NULL) SELECT doc_id, src, dst, 1.0::DOUBLE AS weight FROM s WHERE dst IS NOT NULL UNION ALL SELECT doc_id, dst, src, 1.0 FROM s WHERE dst IS NOT NULL")
def tree_sequential(spark, d):
    return R.sequential_edges(GP._tree(spark, d), symmetric=True).drop("type")


@query(
    "tree_preorder_edges",
    f"""WITH TAPES, {GP.TREE}, {SEMANTIC},
links AS (SELECT doc_id, src, list(dst ORDER BY ord DESC, dst DESC) AS ends FROM (SELECT doc_id, parent_id AS src, seg_id AS dst, ord FROM tree WHERE parent_id IS NOT NULL UNION ALL SELECT doc_id, src, dst, 1048576 FROM se) GROUP BY ALL),
maps AS MATERIALIZED (SELECT doc_id, map_from_entries(list(struct_pack(k := src, v := ends))) AS m FROM links GROUP BY doc_id),
walk AS (
  SELECT doc_id, ['0'] AS stack, []::VARCHAR[] AS done FROM T
  UNION ALL
  SELECT w.doc_id, list_concat(stack[1 : len(stack) - 1], CASE WHEN list_contains(done, stack[-1]) THEN [] ELSE coalesce(m.m[stack[-1]], []) END),
         CASE WHEN list_contains(done, stack[-1]) THEN done ELSE list_append(done, stack[-1]) END
  FROM walk w LEFT JOIN maps m ON m.doc_id = w.doc_id WHERE len(stack) > 0),
ends AS (SELECT doc_id, unnest(done) AS id, generate_subscripts(done, 1) - 1 AS k FROM walk WHERE len(stack) = 0)
SELECT doc_id, k::BIGINT AS k, id FROM ends""",
)
def tree_preorder_edges(spark, d):
    """Depth first over hierarchical edges, then semantic ones, from the root."""
    t = GP._tree(spark, d)
    kids = R.hierarchical_edges(t).join(t.select("doc_id", F.col("seg_id").alias("dst"), "ord"), ["doc_id", "dst"]).select("doc_id", "src", "dst", "ord")
    extra = tree_semantic(spark, d).select("doc_id", "src", "dst", F.lit(1 << 20).alias("ord"))
    return G.preorder_edges(t.select("doc_id", F.col("seg_id").alias("id")), kids.unionByName(extra))


@query("seg_fenced_flags", f"WITH {FENCED} SELECT doc_id, {GP.CODE_SQL.replace('content', 'text')} AS has_code FROM FT")
def seg_fenced_flags(spark, d):
    return fenced(spark, d).select("doc_id", X.has_code(F.col("text")).alias("has_code"))

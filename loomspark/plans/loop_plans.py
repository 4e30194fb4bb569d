"""Queries: loops over rows to a fixed point, table functions, and concepts in conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import models as M
from loomspark.functions import text as X
from loomspark.operators import align as L
from loomspark.operators import attention as A
from loomspark.operators import concepts, folds, refine, segment, spectral, tree
from loomspark.operators import text_attention as TA
from loomspark.plans import attention_plans as AP
from loomspark.plans import graph_plans as GP
from loomspark.plans.registry import query
from loomspark.plans.text_plans import FENCED, PARAS, STRIP, fenced
from loomspark.sources import tapes
from loomspark.sources.scratch import cutter

# a round: pieces over 400 characters are split by the round's criterion, then neighbours joined up to 480
SPLIT = f"""list_filter(list_transform(flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= 400 THEN [p]
  WHEN r = 0 THEN string_split(regexp_replace(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n\\n+', chr(1), 'g'), chr(1))
  WHEN r = 1 THEN string_split(regexp_replace(p, '([,;:])\\s+', '\\1' || chr(1), 'g'), chr(1))
  WHEN r = 2 THEN string_split(replace(p, '<|', chr(1) || '<|'), chr(1))
  ELSE list_transform(range(0, length(p), 400), lambda s: substring(p, s + 1, 400)) END)), lambda p: trim(p, {STRIP})), lambda p: p <> '')"""
MERGE = "list_reduce(list_transform(ss, lambda p: [p]), lambda a, p: CASE WHEN length(a[-1]) + 1 + length(p[1]) <= 480 THEN a[1 : len(a) - 1] || [a[-1] || ' ' || p[1]] ELSE a || p END)"


@query(
    "seg_split_merge",
    f"""WITH RECURSIVE st(doc_id, r, ps, open) AS (
  SELECT doc_id, 0, [trim(text, {STRIP})], length(trim(text, {STRIP})) > 480 FROM documents WHERE trim(text, {STRIP}) <> ''
  UNION ALL
  SELECT doc_id, r + 1, ms, list_sum(list_transform(ms, lambda p: length(p))) > 480 * len(ms) AND (r < 3 OR ms <> ps)
  FROM (SELECT doc_id, r, ps, {MERGE} AS ms FROM (SELECT doc_id, r, ps, {SPLIT} AS ss FROM st WHERE open AND r < 5)))
SELECT doc_id, (generate_subscripts(ps, 1) - 1)::BIGINT AS ord, unnest(ps) AS content, r::BIGINT AS round FROM st WHERE NOT open OR r = 5""",
)
def seg_split_merge(spark, d):
    """Documents in segments of about 400 characters."""
    return AP._longs(refine.split_and_merge(tapes.table(spark, d, "documents").select("doc_id", "text")), "ord", "round")


# all rules on every open segment of every level, until nothing new comes
FRONTIER = f"""rec AS (
  SELECT doc_id, '0' AS seg_id, NULL::VARCHAR AS parent_id, 0 AS level, -1 AS rule_idx, text AS content, 0::BIGINT AS start_pos, false AS atomic FROM T
  UNION ALL
  SELECT doc_id, parent_id || '.' || rule_idx || '-' || lpad((row_number() OVER (PARTITION BY doc_id, parent_id, rule_idx ORDER BY i) - 1)::VARCHAR, 6, '0'), parent_id, level, rule_idx, content, start_pos, {GP.CODE_SQL}
  FROM (
    SELECT doc_id, seg_id AS parent_id, level + 1 AS level, rule_idx, i, trim(raw, {STRIP}) AS content, start_pos + base + length(raw) - length(ltrim(raw, {STRIP})) AS start_pos, count(*) OVER (PARTITION BY doc_id, seg_id, rule_idx) AS n
    FROM (
      SELECT doc_id, seg_id, level, rule_idx, start_pos, i, raw, coalesce(sum(length(raw) + length(sep)) OVER (PARTITION BY doc_id, seg_id, rule_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base
      FROM (
        SELECT rec.doc_id, rec.seg_id, rec.level, ru.k AS rule_idx, rec.start_pos, ru.sep, unnest(string_split(rec.content, ru.sep)) AS raw, generate_subscripts(string_split(rec.content, ru.sep), 1) AS i
        FROM rec, (VALUES (0, chr(10) || chr(10)), (1, chr(10))) ru(k, sep) WHERE NOT rec.atomic))
    WHERE trim(raw, {STRIP}) <> '')
  WHERE n > 1)"""


@query("tree_frontier", f"WITH TAPES, {FRONTIER} SELECT doc_id, seg_id, parent_id, level::BIGINT AS level, rule_idx::BIGINT AS rule_idx, content, start_pos::BIGINT AS start_pos FROM rec")
def tree_frontier(spark, d):
    """Transcripts by paragraphs alone at first; then lines are added as a rule, which every open segment of any level is tried with."""
    cut = cutter(spark, "frontier")
    begun, done = tree.grow(tree.roots(tapes.transcripts(spark, d)), [segment.paragraphs], lambda df, k: cut(df, f"one-{k}"))
    grown, _ = tree.grow(begun, [segment.paragraphs, GP.lines], lambda df, k: cut(df, f"two-{k}"), done)
    return AP._longs(grown.select("doc_id", "seg_id", "parent_id", "level", "rule_idx", "content", F.col("start_pos").cast("long").alias("start_pos")), "level", "rule_idx")


@query("graph_spectral_clusters")
def graph_spectral_clusters(spark, d):
    """Eight clusters of the graph of similar vectors."""
    return spectral.spectral_clusters(GP._pairs(spark, d), 8, chunks=GP._chunks(spark, d)).withColumn("cluster", F.col("cluster").cast("long"))


@query(
    "att_rank_history",
    """WITH RECURSIVE v AS (SELECT vec_id % 2 AS head, vec_id // 2 AS win, list_reverse_sort(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS s FROM embeddings),
c AS (SELECT head, win, len(s)::DOUBLE AS n, list_transform(range(1, len(s) + 1), lambda k: round(list_sum(s[1:k]), 9)) AS c FROM v),
h AS (
  SELECT head, win, greatest(4, least(40, len(list_filter(c, lambda x: x < round(c[-1] * (1 - 0.5), 9))) + 1))::BIGINT AS rank, 0.5::DOUBLE AS target, 0.0::DOUBLE AS before, n FROM c WHERE win = 0
  UNION ALL
  SELECT head, win, greatest(4, least(40, len(list_filter(c, lambda x: x < round(c[-1] * (1 - target), 9))) + 1))::BIGINT, target, before, n
  FROM (SELECT c.head, c.win, c.c, c.n, round((h.before + h.rank / h.n) / (h.win + 1), 9) AS target, h.before + h.rank / h.n AS before FROM h JOIN c ON c.head = h.head AND c.win = h.win + 1))
SELECT head, win, rank, round(target, 6) AS target, round((before + rank / n) / (win + 1), 6) AS mean FROM h""",
)
def att_rank_history(spark, d):
    """Two heads of vectors in order: each one's rank goes by the complexity of those before it."""
    v = tapes.table(spark, d, "embeddings").select((F.col("vec_id") % 2).alias("head"), F.floor(F.col("vec_id") / 2).alias("win"), F.size("embedding").alias("n"), F.reverse(F.array_sort(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("s"))
    return A.adaptive_rank_history(v, 4, 40, chunk=100).withColumns({c: F.round(c, 6) for c in ("target", "mean")})


def _paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip(" \t\n\r\x0b\x0c") for x in text.split("\n\n")) if p]


def _lines(text: str) -> list[str]:
    return [p for p in (x.strip(" \t\n\r\x0b\x0c") for x in text.split("\n")) if p]


@query("seg_table_function", f"WITH TAPES, s AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM T), u AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS i FROM s) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, trim(raw, {STRIP}) AS content FROM u WHERE trim(raw, {STRIP}) <> ''")
def seg_table_function(spark, d):
    """A Python segmenter as a table function, joined laterally in SQL."""
    M.table_function(spark, "paragraphs_of", _paragraphs)
    return spark.sql("SELECT t.doc_id, p.ord, p.content FROM {tapes} t, LATERAL paragraphs_of(t.text) p", tapes=tapes.transcripts(spark, d))


@query("seg_partition_function", f"WITH s AS (SELECT conv_id, turn, string_split(text, chr(10)) AS p FROM conversations), u AS (SELECT conv_id, turn, unnest(p) AS raw, generate_subscripts(p, 1) AS i FROM s) SELECT conv_id AS key, turn AS at, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS ord, trim(raw, {STRIP}) AS content FROM u WHERE trim(raw, {STRIP}) <> ''")
def seg_partition_function(spark, d):
    """Each conversation's turns cut in order, with numbers that go on from turn to turn."""
    M.partition_function(spark, "lines_of", _lines, "conv_id", "turn", "text")
    turns = tapes.table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    return spark.sql("SELECT * FROM lines_of(TABLE(SELECT * FROM {turns}) PARTITION BY conv_id ORDER BY turn)", turns=turns)


WORDS = r"list_distinct(regexp_extract_all(lower(text), '([\p{L}\p{N}\p{M}_]+)'))"
MENTIONS = f"tw AS MATERIALIZED (SELECT conv_id, turn, text, {WORDS} AS w FROM conversations), me AS MATERIALIZED (SELECT DISTINCT conv_id, turn, c AS concept FROM (SELECT conv_id, turn, unnest(w) AS c FROM tw) WHERE length(c) >= 6)"


@query(
    "doc_evolution",
    f"""WITH {MENTIONS}, g AS (SELECT *, CASE WHEN turn - lag(turn) OVER (PARTITION BY conv_id, concept ORDER BY turn) > 2 THEN 1 ELSE 0 END AS new FROM me),
n AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, concept ORDER BY turn) AS thread FROM g),
t AS (SELECT conv_id, concept, thread, min(turn) AS first, max(turn) AS last, count(*) AS mentions FROM n GROUP BY ALL)
SELECT t.conv_id, concept, thread::BIGINT AS thread, first, last, mentions, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(a.w || b.w)), 9) < 0.2 AS changed
FROM t JOIN tw a ON a.conv_id = t.conv_id AND a.turn = first JOIN tw b ON b.conv_id = t.conv_id AND b.turn = last""",
)
def doc_evolution(spark, d):
    """Threads of every concept of every conversation."""
    return concepts.evolution(tapes.table(spark, d, "conversations"))


@query(
    "doc_research",
    f"""WITH {MENTIONS}, e AS (SELECT conv_id, max(turn) AS fin FROM conversations GROUP BY conv_id),
r AS (SELECT me.conv_id, concept, min(me.turn) AS first, max(me.turn) AS last, count(*) AS mentions, sum(({GP.CODE_SQL.replace('content', 'text')})::BIGINT)::BIGINT AS with_code FROM me JOIN tw ON tw.conv_id = me.conv_id AND tw.turn = me.turn GROUP BY ALL),
s AS (SELECT concept, count(*) AS conversations FROM r GROUP BY concept)
SELECT r.conv_id, concept, CASE WHEN mentions >= 2 AND last * 3 >= fin * 2 THEN 'definitive' WHEN mentions >= 2 THEN 'not_taken' WHEN first * 3 <= fin THEN 'early' ELSE 'passing' END AS kind, first, last, mentions, with_code, conversations
FROM r JOIN e USING (conv_id) JOIN s USING (concept)""",
)
def doc_research(spark, d):
    """What became of every concept of every conversation."""
    return concepts.research(tapes.table(spark, d, "conversations"))


# the tokens of transcripts and the paragraphs that hold them, as runs of tokens
SPANS = rf"""tw AS (SELECT doc_id, regexp_split_to_array(text, '\s') AS ws FROM T), te AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM tw),
tx AS (SELECT doc_id, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b, i FROM te),
tn AS MATERIALIZED (SELECT doc_id, b, b + length(w) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM tx WHERE w <> ''), {PARAS.format(tape='T')},
pb AS (SELECT doc_id, i, coalesce(sum(length(raw) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(ltrim(raw, {STRIP})) AS b FROM P0),
po AS (SELECT P.doc_id, row_number() OVER (PARTITION BY P.doc_id ORDER BY P.i) - 1 AS seg, b, b + length(content) AS e FROM P JOIN pb ON P.doc_id = pb.doc_id AND P.i = pb.i),
sp AS MATERIALIZED (SELECT tn.doc_id, seg, min(k) AS first, max(k) + 1 AS past FROM tn JOIN po ON tn.doc_id = po.doc_id AND tn.b < po.e AND tn.e > po.b GROUP BY ALL)"""


def _spans(spark, d):
    """doc_id, seg_idx, begin, end: the paragraphs of transcripts in tokens."""
    docs = tapes.transcripts(spark, d)
    held = L.interval_map(TA.tokens_of(docs), TA.located_pieces(docs).select("doc_id", F.col("ord").alias("seg_idx"), "begin", "end")).filter("n_segs > 0")
    return held.groupBy("doc_id", "seg_idx").agg(F.min("tok_idx").alias("begin"), (F.max("tok_idx") + 1).alias("end"))


@query(
    "win_segment_overlap",
    f"WITH TAPES, {SPANS}, z AS (SELECT doc_id, count(*) AS n FROM tn GROUP BY doc_id), w AS (SELECT doc_id, unnest(range((n + 47) // 48)) AS win_idx FROM z), wp AS (SELECT doc_id, win_idx, unnest(range(64)) AS pos FROM w) SELECT wp.doc_id, win_idx, pos, coalesce(max(seg), 0) AS seg_idx FROM wp LEFT JOIN sp ON sp.doc_id = wp.doc_id AND win_idx * 48 + pos >= first AND win_idx * 48 + pos < past GROUP BY ALL",
)
def win_overlap(spark, d):
    """Windows of 64 tokens over all transcripts, and the paragraph of each of their places."""
    sizes = TA.tokens_of(tapes.transcripts(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))
    wins = sizes.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 48) - 1)).alias("win_idx"))
    wins = wins.select("doc_id", "win_idx", (F.col("win_idx") * 48).alias("begin"), (F.col("win_idx") * 48 + 64).alias("end"))
    return AP._longs(A.window_segments(wins, _spans(spark, d), ["doc_id"]), "win_idx", "pos", "seg_idx")


# what the beginnings of paragraphs add to the attention of windows of 64 tokens
BEGINS = f"{SPANS}, bg AS (SELECT doc_id, first // 64 AS win, first % 64 AS pos FROM sp), r AS (SELECT unnest(range(64)) AS x)"


def _bias(spark, d, kind):
    at = _spans(spark, d).select("doc_id", F.floor(F.col("begin") / 64).alias("win"), (F.col("begin") % 64).alias("pos"))
    return AP._longs(A.bias(at, 64, kind, ["doc_id", "win"]).withColumn("bias", F.round("bias", 6)), "win", "i", "j")


@query("att_bias", f"WITH TAPES, {BEGINS}, a AS (SELECT doc_id, win, pos, x AS a FROM bg JOIN r ON x BETWEEN pos - 1 AND pos WHERE pos > 0), c AS (SELECT doc_id, win, a, x AS c FROM a JOIN r ON x > pos), u AS (SELECT doc_id, win, a AS i, c AS j FROM c UNION ALL SELECT doc_id, win, c, a FROM c) SELECT doc_id, win, i, j, round(sum(-0.5), 6)::DOUBLE AS bias FROM u GROUP BY ALL")
def att_bias(spark, d):
    return _bias(spark, d, "BOUNDARY")


@query("att_bias_evolution", f"WITH TAPES, {BEGINS} SELECT doc_id, win, a.x AS i, b.x AS j, round(sum(0.2), 6)::DOUBLE AS bias FROM bg JOIN r a ON a.x BETWEEN pos - 3 AND pos + 3 JOIN r b ON b.x BETWEEN pos - 3 AND pos + 3 GROUP BY ALL")
def att_bias_evolution(spark, d):
    return _bias(spark, d, "TOPIC_EVOLUTION")


@query("att_bias_reference", f"WITH TAPES, {BEGINS} SELECT doc_id, win, pos AS i, x AS j, round(sum(0.3), 6)::DOUBLE AS bias FROM bg JOIN r ON x < pos GROUP BY ALL")
def att_bias_reference(spark, d):
    return _bias(spark, d, "REFERENCE")


# the words of documents with the marks of sub-word vocabularies, by their length; every eighth a bare mark
@query(
    "tok_clean",
    r"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents), t AS (SELECT DISTINCT CASE WHEN length(w) % 8 = 0 THEN '##' WHEN length(w) % 4 = 0 THEN '##' || w WHEN length(w) % 4 = 1 THEN '▁' || w WHEN length(w) % 4 = 2 THEN 'Ġ' || w ELSE w END AS t FROM w WHERE w <> '')
SELECT t, CASE WHEN trim(replace(replace(replace(t, '##', ''), '▁', ' '), 'Ġ', ' ')) = '' THEN t ELSE trim(replace(replace(replace(t, '##', ''), '▁', ' '), 'Ġ', ' ')) END AS clean FROM t""",
)
def tok_clean(spark, d):
    w = tapes.table(spark, d, "documents").select(F.explode(F.split("text", r"\s+", -1)).alias("w")).filter("w <> ''")
    n = F.length("w")
    mark = F.when(n % 8 == 0, "##").when(n % 4 == 0, F.concat(F.lit("##"), "w")).when(n % 4 == 1, F.concat(F.lit("▁"), "w")).when(n % 4 == 2, F.concat(F.lit("Ġ"), "w")).otherwise(F.col("w"))
    return w.select(mark.alias("t")).distinct().select("t", L.clean_token(F.col("t")).alias("clean"))


# documents in which every fourth line is indented, and their code parted from the text
INDENTED = "SELECT doc_id, string_agg(CASE WHEN i % 4 = 0 THEN '    ' || x ELSE x END, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id"
ISOLATED = rf"""im AS (SELECT doc_id, text, string_split('t' || regexp_replace(text, '(?m)(```[\s\S]*?```|^(?:[ ]{{4,}}|\t).*(?:\n(?:[ ]{{4,}}|\t).*)*)', chr(1) || 'c\1' || chr(1) || 't', 'g'), chr(1)) AS p FROM src),
ik AS (SELECT doc_id, text, list_filter(list_transform(p, lambda x: CASE WHEN x[1] = 'c' THEN x[2:] ELSE trim(x[2:], {STRIP}) END), lambda x: x <> '') AS k FROM im),
ir AS (SELECT doc_id, CASE WHEN len(k) = 1 THEN list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, {STRIP})), lambda x: x <> '') ELSE k END AS k FROM ik),
iso AS (SELECT doc_id, unnest(k) AS content, (generate_subscripts(k, 1) - 1)::BIGINT AS ord FROM ir)"""


@query("seg_code_isolate", f"WITH src AS ({INDENTED}), {ISOLATED} SELECT doc_id, content, ord FROM iso")
def seg_code_isolate(spark, d):
    indent = lambda x, i: F.when((i + 1) % 4 == 0, F.concat(F.lit("    "), x)).otherwise(x)
    rows = tapes.table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), indent), "\n").alias("text"))
    return AP._longs(rows.select("doc_id", F.posexplode(segment.isolate_code(F.col("text"))).alias("ord", "content")), "ord")


@query(
    "tree_explains_edges",
    f"""WITH {FENCED}, src AS (SELECT * FROM FT), {ISOLATED}, s AS (SELECT doc_id, ord, {GP.CODE_SQL} AS has_code, {GP.MATH_SQL} AS has_math FROM iso),
o AS (SELECT *, lag(ord) OVER w AS p, lag(has_code) OVER w AS pc, lead(ord) OVER w AS n, lead(has_code) OVER w AS nc FROM s WHERE has_code OR NOT has_math WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, p AS src, ord AS dst, 0.9::DOUBLE AS weight FROM o WHERE has_code AND p IS NOT NULL AND NOT pc
UNION ALL SELECT doc_id, n, ord, 0.7 FROM o WHERE has_code AND n IS NOT NULL AND NOT nc""",
)
def tree_explains_edges(spark, d):
    """The pieces of documents in which every third line is a fenced block."""
    pieces = fenced(spark, d).select("doc_id", F.posexplode(segment.isolate_code(F.col("text"))).alias("ord", "content"))
    rows = pieces.select("doc_id", F.col("ord").cast("long").alias("seg_id"), F.lit("0").alias("parent_id"), F.lit(0).alias("rule_idx"), F.col("ord").alias("start_pos"), X.has_code(F.col("content")).alias("has_code"), X.has_math(F.col("content")).alias("has_math"))
    return tree.explains_edges(rows).select("doc_id", "src", "dst", "weight")


@query("att_fold_flow", f"WITH {AP.ATTN} SELECT window_idx, i, flow FROM flow")
def att_fold_flow(spark, d):
    """Flow by a fold over the cells as they lie."""
    return folds.run_fold(A.layer_mean(tapes.attention(spark, d), tapes.LAYERS), "window_idx", folds.FlowFold(tapes.HEADS)).withColumn("flow", F.round("flow", 9))


@query("att_fold_entropy", f"WITH {AP.ATTN}, e AS (SELECT window_idx, head, i, -sum((w + 1e-10) / t * ln((w + 1e-10) / t)) AS h FROM (SELECT *, sum(w + 1e-10) OVER (PARTITION BY window_idx, head, i) AS t FROM cells) GROUP BY ALL) SELECT window_idx, round(avg(h), 6) AS entropy FROM e WHERE window_idx IN (SELECT window_idx FROM size WHERE n = 32) GROUP BY window_idx")
def att_fold_entropy(spark, d):
    """Entropy of the windows of full size by a fold."""
    cells = A.layer_mean(tapes.attention(spark, d), tapes.LAYERS)
    full = AP._sizes(spark, d).filter(F.col("n") == tapes.WINDOW).select("window_idx")
    return folds.run_fold(cells.join(full, "window_idx"), "window_idx", folds.EntropyFold(tapes.WINDOW)).withColumn("entropy", F.round("entropy", 6))

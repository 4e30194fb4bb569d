"""Queries: segmentation and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import segment as S
from loomspark.operators import windows as W
from loomspark.plans.registry import query
from loomspark.sources import tapes

STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
BREAK = "chr(10) || chr(10)"

PARAS = f"""
PP AS (SELECT doc_id, string_split(text, {BREAK}) AS ps FROM {{tape}}),
P0 AS (SELECT doc_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i FROM PP),
P AS (SELECT doc_id, i, trim(raw, {STRIP}) AS content, raw FROM P0 WHERE trim(raw, {STRIP}) <> '')"""


@query("seg_paragraphs", "WITH TAPES, " + PARAS.format(tape="T") + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, content, length(content) AS n_chars FROM P")
def seg_paragraphs(spark, d):
    rows = tapes.transcripts(spark, d).select("doc_id", F.posexplode(S.paragraphs(F.col("text"))).alias("ord", "content"))
    return rows.withColumn("ord", F.col("ord").cast("long")).withColumn("n_chars", F.length("content").cast("long"))


@query("seg_sentences", "WITH TAPES, s AS (SELECT doc_id, string_split(text, '. ') AS p FROM L) SELECT doc_id, unnest(p) AS sentence, (generate_subscripts(p, 1) - 1)::BIGINT AS ord FROM s")
def seg_sentences(spark, d):
    return tapes.spaced_documents(spark, d).select("doc_id", F.posexplode(F.split("text", r"\. ", -1)).alias("ord", "sentence")).withColumn("ord", F.col("ord").cast("long"))


@query(
    "seg_sections",
    rf"""WITH TAPES,
a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM H),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM a),
f AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+.+$') AS h FROM ln),
g AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM f),
s AS (SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY n) || chr(10) AS content, min(n) AS start_line, arg_min(line, n) AS first, arg_min(h, n) AS headed FROM g GROUP BY doc_id, sec)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS ord,
  CASE WHEN headed THEN length(regexp_extract(first, '^(#{{1,6}})\s', 1)) ELSE 0 END::BIGINT AS level,
  CASE WHEN headed THEN trim(regexp_extract(first, '^#{{1,6}}\s+(.+)$', 1), {STRIP}) ELSE 'Preamble' END AS title,
  content, start_line::BIGINT AS start_line
FROM s WHERE trim(content, {STRIP}) <> ''""",
)
def seg_sections(spark, d):
    r = S.sections(tapes.markdown_pages(spark, d))
    return r.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("level").cast("long").alias("level"), "title", "content", F.col("start_line").cast("long").alias("start_line"))


def case_values(rows):
    show = lambda v: "NULL" if v is None else "true" if v is True else "false" if v is False else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


@query(
    "seg_seedable_chunks",
    r"""WITH RECURSIVE s AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
n AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM s),
w AS (
  SELECT doc_id, i, 1 AS c, length(x) AS len FROM n WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i, CASE WHEN w.len > 0 AND w.len + length(n.x) > 100 THEN c + 1 ELSE c END,
         CASE WHEN w.len > 0 AND w.len + length(n.x) > 100 THEN length(n.x) WHEN w.len = 0 THEN length(n.x) ELSE w.len + 1 + length(n.x) END
  FROM w JOIN n ON n.doc_id = w.doc_id AND n.i = w.i + 1),
g AS (SELECT n.doc_id, w.c, string_agg(n.x, ' ' ORDER BY n.i) AS content FROM n JOIN w ON n.doc_id = w.doc_id AND n.i = w.i GROUP BY n.doc_id, w.c)
SELECT doc_id, (c - 1)::BIGINT AS ord, content FROM g WHERE content <> ''""",
)
def seg_seedable_chunks(spark, d):
    docs = tapes.table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(S.seedable_chunks(F.col("text"))).alias("ord", "content")).withColumn("ord", F.col("ord").cast("long"))


@query("seg_chunk_1024", "WITH TAPES SELECT doc_id, unnest(range(0, length(text), 1024)) // 1024 AS ord, substring(text, unnest(range(0, length(text), 1024)) + 1, 1024) AS content FROM L")
def seg_chunk_1024(spark, d):
    return tapes.spaced_documents(spark, d).select("doc_id", F.posexplode(S.fixed_chunks(F.col("text"))).alias("ord", "content")).withColumn("ord", F.col("ord").cast("long"))


@query("seg_speaker_turns", r"WITH TAPES SELECT doc_id, regexp_replace(text, '((?:^|\n)(?:Speaker\s+)?[A-Za-z0-9]+):\s*', '<SPEAKER_BOUNDARY>\0</SPEAKER_BOUNDARY>', 'g') AS text FROM T")
def seg_speaker_turns(spark, d):
    return tapes.transcripts(spark, d).select("doc_id", S.mark_speakers(F.col("text")).alias("text"))


BOUNDS = r"""
s0 AS (SELECT doc_id, string_split(text, '. ') AS p FROM L),
s1 AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM s0),
s2 AS (SELECT *, coalesce(sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, list_distinct(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+')) AS ws FROM s1),
s3 AS (SELECT *, lag(ws) OVER (PARTITION BY doc_id ORDER BY i) AS pw FROM s2),
s4 AS (SELECT doc_id, pos, CASE WHEN pw IS NULL THEN NULL WHEN len(pw) = 0 OR len(ws) = 0 THEN 0.0 ELSE len(list_intersect(pw, ws)) / sqrt(len(pw)::DOUBLE * len(ws)) END AS sim FROM s3),
s5 AS (SELECT *, round(avg(sim) OVER (PARTITION BY doc_id) - stddev_pop(sim) OVER (PARTITION BY doc_id), 9) AS cut FROM s4),
low AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM s5 WHERE round(sim, 9) < cut),
walk AS (
  SELECT doc_id, k, pos, pos >= 100 AS taken, CASE WHEN pos >= 100 THEN pos ELSE 0 END AS last FROM low WHERE k = 1
  UNION ALL
  SELECT l.doc_id, l.k, l.pos, l.pos - w.last >= 100, CASE WHEN l.pos - w.last >= 100 THEN l.pos ELSE w.last END
  FROM walk w JOIN low l ON l.doc_id = w.doc_id AND l.k = w.k + 1)"""


@query("seg_semantic_boundaries", f"WITH TAPES, {BOUNDS} SELECT doc_id, pos FROM walk WHERE taken")
def seg_semantic_boundaries(spark, d):
    return S.semantic_boundaries(tapes.spaced_documents(spark, d))


@query(
    "seg_semantic_pieces",
    f"""WITH TAPES, {BOUNDS},
st AS (SELECT doc_id, pos FROM walk WHERE taken UNION SELECT doc_id, 0 FROM L),
sp AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nx, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord FROM st)
SELECT sp.doc_id, ord, pos AS start_pos, substring(text, pos + 1, coalesce(nx, length(text)) - pos) AS content
FROM sp JOIN L ON L.doc_id = sp.doc_id WHERE trim(substring(text, pos + 1, coalesce(nx, length(text)) - pos), {STRIP}) <> ''""",
)
def seg_semantic_pieces(spark, d):
    docs = tapes.spaced_documents(spark, d)
    r = S.cut_at(docs, S.semantic_boundaries(docs))
    return r.withColumn("ord", F.col("ord").cast("long"))


@query("seg_key_concept", rf"WITH TAPES SELECT doc_id, CASE WHEN regexp_extract(text, '\*\*(.+?)\*\*', 1) <> '' THEN regexp_extract(text, '\*\*(.+?)\*\*', 1) WHEN length(trim(split_part(text, '.', 1), {STRIP})) < 100 THEN trim(split_part(text, '.', 1), {STRIP}) END AS concept FROM L")
def seg_key_concept(spark, d):
    return tapes.spaced_documents(spark, d).select("doc_id", X.key_concept(F.col("text")).alias("concept"))


def _pack_sql(tape: str) -> str:
    return f"""{PARAS.format(tape=tape)},
PN AS (SELECT doc_id, regexp_replace(raw, '\\n{{3,}}', {BREAK}, 'g') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM P),
PW AS (
  SELECT doc_id, i, 1 AS win, length(x) AS len FROM PN WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN w.len + length(p.x) > 1000 THEN win + 1 ELSE win END,
         CASE WHEN w.len + length(p.x) > 1000 THEN length(p.x) ELSE w.len + 2 + length(p.x) END
  FROM PW w JOIN PN p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
WN AS (
  SELECT PN.doc_id, (win - 1)::BIGINT AS win_idx, regexp_replace(trim(string_agg(x, {BREAK} ORDER BY PN.i), {STRIP}), '\\n{{3,}}', {BREAK}, 'g') AS text
  FROM PN JOIN PW ON PN.doc_id = PW.doc_id AND PN.i = PW.i GROUP BY PN.doc_id, win)"""


PACK = _pack_sql("T")

# documents with every third line as a fenced block
FENCED = "FT AS (SELECT doc_id, string_agg(CASE WHEN i % 3 = 0 THEN '```' || chr(10) || x || chr(10) || '```' ELSE x END, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id)"


def fenced(spark, d):
    """doc_id, text: documents with every third line as a fenced block."""
    mark = lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("```\n"), x, F.lit("\n```"))).otherwise(x)
    return tapes.table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("text"))


# the seedable chunks C (doc_id, x, i from 0, n) of the transcripts
CHUNKS = rf"""{PARAS.format(tape="T")},
QN AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM T WHERE NOT contains(text, {BREAK}))),
QW AS (
  SELECT doc_id, i, 1 AS c, length(x) AS len FROM QN WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i, CASE WHEN w.len > 0 AND w.len + length(n.x) > 100 THEN c + 1 ELSE c END,
         CASE WHEN w.len > 0 AND w.len + length(n.x) > 100 THEN length(n.x) WHEN w.len = 0 THEN length(n.x) ELSE w.len + 1 + length(n.x) END
  FROM QW w JOIN QN n ON n.doc_id = w.doc_id AND n.i = w.i + 1),
QG AS (SELECT QN.doc_id, c, string_agg(x, ' ' ORDER BY QN.i) AS x FROM QN JOIN QW ON QN.doc_id = QW.doc_id AND QN.i = QW.i GROUP BY QN.doc_id, c),
CU AS (SELECT P.doc_id, raw AS x, P.i FROM P JOIN T ON T.doc_id = P.doc_id AND contains(T.text, {BREAK}) UNION ALL SELECT doc_id, x, c FROM QG WHERE x <> ''),
C AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM CU)"""


def _packed(spark, d):
    return tapes.transcripts(spark, d).select("doc_id", F.posexplode(W.packed_paragraphs(F.col("text"))).alias("win_idx", "text"))


@query("win_pack_1000", f"WITH TAPES, {PACK} SELECT doc_id, win_idx, text, length(text) AS n_chars FROM WN")
def win_pack_1000(spark, d):
    return _packed(spark, d).select("doc_id", F.col("win_idx").cast("long").alias("win_idx"), "text", F.length("text").cast("long").alias("n_chars"))


@query(
    "win_fallback_words",
    r"""WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT doc_id, w, len(w) AS n, 200 - CASE WHEN len(w) > 600 THEN 30 WHEN len(w) > 200 THEN 40 ELSE 50 END AS step FROM a),
c AS (SELECT doc_id, w, unnest(range(0, n, step)) AS s, step FROM b)
SELECT doc_id, (s // step)::BIGINT AS win_idx, array_to_string(w[s + 1 : s + 200], ' ') AS text FROM c""",
)
def win_fallback_words(spark, d):
    docs = tapes.table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(W.word_windows(F.col("text"))).alias("win_idx", "text")).withColumn("win_idx", F.col("win_idx").cast("long"))


PERC = rf"""{PACK},
V AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM WN),
V2 AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY win_idx) AS nw, lead(text, 2) OVER (PARTITION BY doc_id ORDER BY win_idx) AS nt2 FROM V),
V3 AS (SELECT *, len(list_intersect(list_distinct(w[greatest(len(w) - 25 + 1, 1) : len(w)]), list_distinct(nw[1 : 25]))) AS overlap FROM V2)"""


@query("win_percolation_overlap", f"WITH TAPES, {PERC} SELECT doc_id, win_idx, overlap::BIGINT AS overlap, round(overlap / len(w), 6) AS ratio FROM V3 WHERE nw IS NOT NULL")
def win_percolation_overlap(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("win_idx")
    rows = _packed(spark, d).withColumn("w", X.words(F.col("text"))).withColumn("nw", F.lead("w").over(order)).filter("nw IS NOT NULL")
    rows = rows.withColumn("overlap", W.window_overlap(F.col("w"), F.col("nw"), 100).cast("long"))
    return rows.select("doc_id", F.col("win_idx").cast("long").alias("win_idx"), "overlap", F.round(F.col("overlap") / F.size("w"), 6).alias("ratio"))


@query(
    "win_intermediate",
    f"""WITH TAPES, {PERC},
I AS (SELECT doc_id, win_idx + 0.5 AS spot, array_to_string(list_concat(w[greatest(len(w) - 19, 1) : len(w)], nw[1:20]), ' ') AS text, true AS inserted FROM V3
      WHERE nw IS NOT NULL AND overlap / len(w) < 0.2 AND len(w) >= 25 AND len(nw) >= 25),
A AS (SELECT doc_id, win_idx::DOUBLE AS spot, text, false AS inserted FROM WN UNION ALL SELECT doc_id, spot::DOUBLE, text, inserted FROM I)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS win_idx, text, inserted FROM A""",
)
def win_intermediate(spark, d):
    return W.percolated(_packed(spark, d), size=100).withColumn("win_idx", F.col("win_idx").cast("long"))


@query(
    "win_graph_edges",
    rf"""WITH TAPES, {PERC},
S AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(nt2), '[\p{{L}}\p{{N}}_]+')) AS b FROM V3),
J AS (SELECT *, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS j FROM S WHERE nt2 IS NOT NULL AND len(a) > 0 AND len(b) > 0)
SELECT doc_id, win_idx AS source, win_idx + 1 AS target, round(least(1.0, overlap / len(w) / 0.2), 6) AS weight, overlap::BIGINT AS overlap, NULL::VARCHAR AS type FROM V3 WHERE nw IS NOT NULL
UNION ALL
SELECT doc_id, win_idx, win_idx + 2, round(j, 6), NULL, 'semantic' FROM J WHERE j > 0.3""",
)
def win_graph_edges(spark, d):
    g = W.window_graph(_packed(spark, d), size=100)
    return g.select("doc_id", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), F.round("weight", 6).alias("weight"), F.col("overlap").cast("long").alias("overlap"), "type")


def _token_sql(stride, last):
    return rf"""WITH a AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents),
b AS (SELECT doc_id, n, unnest(CASE WHEN n <= 64 THEN [0] ELSE range(0, {last}, {stride}) END) AS start FROM a)
SELECT doc_id, (start // {stride})::BIGINT AS win_idx, start::BIGINT AS start, least(64, n - start)::BIGINT AS n_tokens FROM b"""


def _token_query(name, step, full_only=False):
    @query(name, _token_sql(int(64 * step), "n - 63" if full_only else "n"))
    def run(spark, d):
        r = W.token_windows(tapes.table(spark, d, "documents"), 64, step, full_only)
        return r.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("win_idx", "start", "n_tokens")])


_token_query("win_token_sliding", 0.5)
_token_query("win_token_tumbling", 1.0)
_token_query("win_token_quick", 0.75)
_token_query("win_token_full_only", 0.5, True)


@query("vec_jaccard", rf"WITH TAPES, {PACK}, s AS (SELECT doc_id, win_idx, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS a FROM WN), n AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY win_idx) AS b FROM s) SELECT doc_id, win_idx, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM n WHERE b IS NOT NULL")
def vec_jaccard(spark, d):
    from pyspark.sql import Window

    rows = _packed(spark, d).withColumn("a", X.word_set(F.col("text")))
    rows = rows.withColumn("b", F.lead("a").over(Window.partitionBy("doc_id").orderBy("win_idx"))).filter("b IS NOT NULL")
    return rows.select("doc_id", F.col("win_idx").cast("long").alias("win_idx"), F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))

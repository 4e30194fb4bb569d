"""License scans: sparse TF-IDF cosine of lines, windows and whole texts to templates, then inheritance by directory.

Only DataFrame functions. Units are all lines of a text, the text itself, and around anchors the windows of as many terms as a template
has, whatever the line breaks; a window meets templates of its own length. A unit can reach the threshold only if it holds
one of the anchors: for every template the terms without anchors carry less than the threshold's share of its length
(Cauchy-Schwarz), so the regular expression over anchors loses nothing. A row that names a licence has its own; any other row
takes that of the nearest directory above it that holds a licence file, resolved once for each directory.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import NULL_ID, Scratch, hot_split_join
from loomspark.llm.license_templates import FAMILIES, MODIFIERS, TEMPLATES, TEXTS, TITLES, TWO_CLAUSES

TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.translate(str.maketrans(UPPER, LOWER)))


def template_weights(templates: list[tuple[str, str]]) -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """(template, term, weight / length) of each, the terms' idf, and that of any other term. What counts for the idf is how many licences
    hold a term in any template: many wordings of one licence don't make its words less telling."""
    counts = [Counter(_terms(text)) for _, text in templates]
    df = Counter(t for name in {n for n, _ in templates} for t in {t for (own, _), c in zip(templates, counts, strict=True) if own == name for t in c})
    n = len({name for name, _ in templates})
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in sorted(df)}
    rows = []
    for k, c in enumerate(counts):
        length = math.sqrt(sum((f * idf[t]) ** 2 for t, f in c.items()))
        rows += [(k, t, f * idf[t] / length) for t, f in sorted(c.items())]
    return rows, idf, math.log(1 + n) + 1


def telling(templates: list[tuple[str, str]]) -> tuple[dict[str, int], list[int], int]:
    """A bit for each version and each of FAMILIES and MODIFIERS: those of terms, those that each template asks of a unit, and all of MODIFIERS.

    A version is a number with a point, or one behind "version" or "v"; 2, 2.0, v2 and v2.0 are one version.
    """
    kinds, asked = [*MODIFIERS, *FAMILIES], []
    for _, text in templates:
        ts = _terms(text)
        versions = {t.removesuffix(".0") for before, t in zip(["", *ts], ts) if re.fullmatch(r"\d+(\.\d+)?", t) and ("." in t or before in ("version", "v"))}
        asked.append(versions | (set(ts) & {*MODIFIERS, *FAMILIES}))
    kinds += sorted(set().union(*asked) - set(kinds))
    bits = {t: 1 << k for k, t in enumerate(kinds)}
    spelled = {v + t + end: b for t, b in bits.items() if t[0].isdigit() and "-" not in t for v in ("", "v") for end in ("", *([] if "." in t else [".0"]))}
    return bits | spelled, [sum(bits[t] for t in a) for a in asked], sum(bits[t] for t in MODIFIERS)


# Words too common in running text to look for; they stay outside the anchors first.
COMMON = "1 2 3 the and of in to is or with are this that by all under mit a v from into your any for be at you it not may can if was its do so as on one use used file free work form 2.0 4.0 without person persons provided published must above following list other code library name names program version software copy copies source public general either later option found file conditions terms subject international such some state over which while still given means names either except intent open available document documents individual organization contents using otherwise both appear package individual february march june november january list prior specific products forms materials legal free including deal charge fee sell merge copying written distribute distributed purpose".split()
# A file of one of these names is a licence file, whatever its text.
FILE_NAME = r"(?i)^(\w+-)?(licen[sc]e|copying|copyright)(-[\w-]+(\.\d+)?)?(\.(txt|md|rst|html?|lesser))?$"
FOREIGN = ["mit"]  # anchors that another language's running text is full of
CHUNK, FINE = 1024, 16  # terms a chunk; windows shorter than FINE start at every term, others at every eighth of their length and where a template's term fits


def template_anchors(weights: list[tuple[int, str, float]], threshold: float) -> dict[int, set[str]]:
    """Per template the terms of which each unit within its reach holds one. One term alone names no licence, so the first to stay outside may be of any weight."""
    chosen: dict[int, set[str]] = {}
    for k in sorted({r[0] for r in weights}):
        rest, outside = 0.0, 0
        for _, t, w in sorted((r for r in weights if r[0] == k), key=lambda r: (COMMON.index(r[1]) if r[1] in COMMON else len(COMMON), r[2], r[1])):
            if not outside or rest + w * w < (threshold * 0.999) ** 2:
                rest, outside = rest + w * w, outside + 1
            else:
                chosen.setdefault(k, set()).add(t)
    return chosen


def anchors(weights: list[tuple[int, str, float]], threshold: float) -> list[str]:
    """Terms of which each unit within reach of any template holds one."""
    return sorted(set().union(*template_anchors(weights, threshold).values()))


def company(weights: list[tuple[int, str, float]], threshold: float) -> dict[str, set[str]]:
    """FOREIGN anchors, each with the terms of which a unit that it leads to a template holds one as well."""
    found: dict[str, set[str]] = {}
    for k, chosen in template_anchors(weights, threshold).items():
        own = {t: w * w for i, t, w in weights if i == k}
        for anchor in chosen & set(FOREIGN):
            mass, others = own[anchor], []
            for t in sorted(own.keys() - {anchor}, key=lambda t: (COMMON.index(t) if t in COMMON else len(COMMON), own[t], t)):
                if mass + own[t] < (threshold * 0.999) ** 2:
                    mass += own[t]
                else:
                    others.append(t)
            found.setdefault(anchor, set()).update(others)
    return found


def _any_of(terms: list[str]) -> str:
    """A regular expression for the terms, by first letters, since a plain list of so many is slow."""
    heads = sorted({t[0] for t in terms})
    rest = lambda h: sorted((re.escape(t[1:]) for t in terms if t[0] == h), key=len, reverse=True)
    return "(?i)(?<![A-Za-z0-9])(?:" + "|".join(f"{re.escape(h)}(?:{'|'.join(rest(h))})" for h in heads) + ")(?![A-Za-z0-9])"


def _anchored(text: Column, weights: list[tuple[int, str, float]], threshold: float) -> Column:
    """The text holds an anchor, and if that is a foreign word also one of its company."""
    weak = company(weights, threshold)
    found = text.rlike(_any_of(sorted(set(anchors(weights, threshold)) - weak.keys())))
    for anchor, others in sorted(weak.items()):
        found = found | (text.rlike(_any_of([anchor])) & text.rlike(_any_of(sorted(others))))
    return found


def _windows(hits: DataFrame, scratch: Scratch, templates: list[tuple[str, str]], weights: list[tuple[int, str, float]], threshold: float) -> DataFrame:
    """__id, n, unit, term: the terms of each window of n terms from term number unit on that lies around an anchor.

    A cosine is at most the root of what the window's terms carry of the template's squared length; by that bound first whole chunks,
    then single windows are left out. Both steps are written tables, or the optimizer would copy one's expressions into the loops of the next.
    """
    least = (threshold * 0.999) ** 2
    table, longest = [], 1
    for k, found in template_anchors(weights, threshold).items():
        ts = _terms(templates[k][1])
        if templates[k] in TITLES:
            continue
        longest = max(longest, len(ts))
        places = {(t, o) for j, t in enumerate(ts) if t in found for o in ((-1,) if len(ts) < FINE else (-1, j))}
        table.append({"n": len(ts), "terms": [{"t": t, "w": w * w} for i, t, w in weights if i == k], "at": [{"t": t, "o": o} for t, o in sorted(places)]})
    if not table:
        return hits.select("__id", F.lit(0).alias("n"), F.lit(0).alias("unit"), "text").filter("false").withColumnRenamed("text", "term")
    # single literals: a column for each value takes seconds to build
    words = lambda key: F.split(F.lit(" ".join(sorted({e["t"] for x in table for e in x[key]}))), " ")
    all_templates = F.from_json(F.lit(json.dumps(table)), "array<struct<n:int,terms:array<struct<t:string,w:double>>,at:array<struct<t:string,o:int>>>>")

    def covers(held: Column, template: Column) -> Column:
        return F.aggregate(template["terms"], F.lit(0.0), lambda sum, e: sum + F.when(F.array_contains(held, e["t"]), e["w"]).otherwise(F.lit(0.0))) >= least

    def starts(at: Column, n: Column, o: Column) -> Column:
        step = F.when(n < FINE, 1).otherwise(F.floor(n / 8).cast("int"))
        grid = F.transform(F.sequence(F.lit(0), F.floor(n / step).cast("int")), lambda k: (F.floor(at / step).cast("int") - k) * step)
        return F.when(o >= 0, F.array(at - o)).otherwise(grid)

    def around(template: Column) -> Column:
        """The template's windows in the chunk that can reach it."""
        n = template["n"]
        own = lambda x: F.filter(template["at"], lambda a: a["t"] == x["t"])
        at = F.filter(F.transform("part", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: F.array_contains("anchors", x["t"]))
        spots = F.flatten(F.transform(at, lambda x: F.flatten(F.transform(own(x), lambda a: starts(x["i"], n, a["o"])))))
        spots = F.filter(F.array_distinct(spots), lambda s: (s >= 0) & (s < CHUNK) & (s + n <= F.size("part")))
        found = F.transform(spots, lambda s: F.struct(n.alias("n"), (F.col("base") + s).alias("unit"), F.slice("part", s + 1, n).alias("terms")))
        return F.filter(found, lambda w: covers(w["terms"], template))

    rows = hits.select("__id", F.regexp_extract_all(_lower(F.col("text")), F.lit(f"({TERM})")).alias("terms"))
    rows = rows.filter(F.size("terms") > 0).select("__id", "terms", F.explode(F.sequence(F.lit(0), F.size("terms") - 1, F.lit(CHUNK))).alias("base"))
    rows = rows.select("__id", "base", F.slice("terms", F.col("base") + 1, F.lit(CHUNK + longest)).alias("part"))
    chunks = rows.select("*", F.array_intersect("part", words("terms")).alias("held"), F.array_intersect("part", words("at")).alias("anchors"))
    chunks = scratch.write(chunks, "chunks").filter(F.size("anchors") > 0)
    near = F.filter(all_templates, lambda x: covers(F.col("held"), x))
    found = scratch.write(chunks.select("__id", F.array_distinct(F.flatten(F.transform(near, around))).alias("found")), "windows")
    scratch.drop("chunks")
    return found.select("__id", F.explode("found").alias("w")).select("__id", "w.n", "w.unit", F.explode("w.terms").alias("term"))


def _known(idf: dict[str, float], other: float, bits: dict[str, int]) -> list[tuple[str, float, int]]:
    return [(t, idf.get(t, other), bits.get(t, 0)) for t in sorted(idf.keys() | bits.keys())]


def _values(rows: list[tuple]) -> str:
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) + ("D" if isinstance(v, float) else "")
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan_licenses(docs: DataFrame, path_col: str, templates: list[tuple[str, str]] | None = None, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, license, score (6 decimals), origin ("own", "inherited", "none"), license_dir, license_id.

    A row's own licence is the template with the highest cosine, at least threshold, over its lines, its windows and its whole text; ties go
    to the earlier template, and "proprietary" is for rows that name no other licence, since licence texts reserve rights too. TITLES count
    as whole lines and whole texts only. Whatever the cosine, a unit must hold the version and the telling words that its template holds
    (FAMILIES, MODIFIERS), and no other MODIFIERS, so neighbouring versions and kinds aren't taken for each other. The row is a licence file of its directory if its first line or whole text reaches the threshold, if its
    best window is its very start, or if a text that grants a licence (TEXTS) begins within its first 40 terms. Of several in a directory
    the highest score counts, then the smallest id. A file named as licence files are (FILE_NAME) whose text reaches no template is a
    licence file of the licence "unknown" with null score; it counts after all others of its directory. A row without its own takes that of the nearest directory on its path that has a
    licence file, its own directory first, the root ("") last.

    Null or empty text matches nothing. A null path lies in the root. A null id counts as the smallest and comes back null; rows that repeat an
    id share their best match. Other columns stay out. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    templates = templates or TEMPLATES
    weights, idf, other_idf = template_weights(templates)
    bits, asked, modifiers = telling(templates)
    size = [-1 if t in TITLES else len(_terms(t[1])) for t in templates]
    table = spark.sql(f"SELECT * FROM VALUES {_values([(*w, size[w[0]], asked[w[0]]) for w in weights])} AS t(template, term, weight, size, asked)")
    terms = spark.sql(f"SELECT * FROM VALUES {_values(_known(idf, other_idf, bits))} AS t(term, idf, bits)")

    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id")
    rows = docs.select(key, F.col(text_col).alias("text"), F.coalesce(F.col(path_col), F.lit("")).alias("path"))
    strange = F.regexp_replace("path", "^.*/", "").rlike(FILE_NAME) & F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    hits = scratch.write(rows.select("__id", "text").filter(_anchored(F.col("text"), weights, threshold)), "hits")
    lines = hits.select("__id", F.posexplode(F.split("text", "\n", -1)).alias("unit", "line")).filter(_anchored(F.col("line"), weights, threshold))
    units = lines.unionByName(hits.select("__id", F.lit(-1).alias("unit"), F.col("text").alias("line")))
    words = units.select("__id", F.lit(0).alias("n"), "unit", F.explode(F.regexp_extract_all(_lower(F.col("line")), F.lit(f"({TERM})"))).alias("term"))
    words = words.unionByName(_windows(hits, scratch, templates, weights, threshold))
    counts = words.groupBy("__id", "n", "unit", "term").agg(F.count("*").alias("tf")).join(F.broadcast(terms), "term", "left")
    counts = counts.select("__id", "n", "unit", "term", (F.col("tf") * F.coalesce("idf", F.lit(other_idf))).alias("x"), F.coalesce("bits", F.lit(0)).alias("bits"))
    counts = scratch.write(counts, "counts")
    meets = (F.col("c.term") == F.col("t.term")) & ((F.col("n") == 0) | (F.col("n") == F.col("size")))
    dots = counts.alias("c").join(F.broadcast(table.alias("t")), meets).groupBy("__id", "n", "unit", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.max("asked").alias("asked"), F.count("*").alias("shared"))
    dots = dots.filter("shared > 1").drop("shared")  # one word alone ("mit", "from") names no licence
    lengths = counts.groupBy("__id", "n", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.bit_or("bits").alias("bits"))
    same = F.col("bits").bitwiseAND(F.col("asked")) == F.col("asked")
    same = same & (F.col("bits").bitwiseAND(F.lit(modifiers)).bitwiseOR(F.col("asked")) == F.col("asked"))
    cosines = dots.join(lengths, ["__id", "n", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).filter((F.col("score") >= threshold) & same)
    named = ~F.col("template").isin([k for k, (t, _) in enumerate(templates) if t == "proprietary"])
    grants = F.col("template").isin([k for k, t in enumerate(templates) if t in TEXTS or t in TWO_CLAUSES]) & (F.col("unit") < 40)
    own = cosines.groupBy("__id").agg(
        # bitwise_not turns an order round without overflow
        F.max(F.struct(named.alias("named"), "score", F.bitwise_not("template").alias("neg"), (F.col("unit") <= 0).alias("first"))).alias("best"),
        F.max(F.when(F.col("n") == 0, F.col("unit") <= 0).otherwise(grants)).alias("is_file"),
    )
    own = scratch.write(own.select("__id", F.col("best.score").alias("score"), F.bitwise_not("best.neg").alias("template"), (F.col("is_file") | F.col("best.first")).alias("is_file")), "own")

    scratch.drop("hits", "windows", "counts")
    placed = rows.select("__id", _parent(F.col("path")).alias("dir"), strange.alias("strange")).join(own.hint("merge"), "__id", "left")
    unknown = F.col("strange") & F.col("template").isNull()
    placed = placed.select("__id", "dir", "score", F.when(unknown, len(templates)).otherwise(F.col("template")).alias("template"), (unknown | F.col("is_file")).alias("is_file"))
    placed = scratch.write(placed, "placed")
    scratch.drop("own")
    files = placed.filter("is_file").groupBy("dir").agg(F.max(F.struct("score", F.bitwise_not("__id").alias("neg"), "template")).alias("f"))
    dirs = placed.filter("template IS NULL").groupBy("dir").agg(F.count("*").alias("rows"))
    dirs = scratch.write(dirs, "dirs")
    segments = F.split("dir", "/", -1)
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.slice(segments, 1, k), "/"))))
    climb = scratch.write(dirs.select("dir", F.explode(above).alias("up")), "climb")
    held = climb.groupBy("up").agg(F.count("*").alias("n")).join(files.withColumnRenamed("dir", "up"), "up")
    held = scratch.write(held, "held")
    nearest = hot_split_join(climb, held, "up", "n").groupBy("dir").agg(F.max_by(F.struct("up", "f"), F.length("up")).alias("near"))
    nearest = scratch.write(nearest.join(dirs, "dir"), "nearest")
    scratch.drop("climb", "held")

    name = F.element_at(F.array(*[F.lit(t) for t, _ in templates], F.lit("unknown")), F.col("template") + 1)
    real = lambda c: F.when(c != NULL_ID, c)
    mine = placed.filter("template IS NOT NULL").select("__id", name.alias("license"), "score", F.lit("own").alias("origin"), F.col("dir").alias("license_dir"), F.col("__id").alias("from_id"))
    without = placed.filter("template IS NULL").select("__id", "dir")
    taken = hot_split_join(without, nearest, "dir", "rows").withColumns({"template": F.col("near.f.template"), "score": F.col("near.f.score")})
    taken = taken.select("__id", name.alias("license"), "score", F.lit("inherited").alias("origin"), F.col("near.up").alias("license_dir"), F.bitwise_not("near.f.neg").alias("from_id"))
    bare = dirs.join(nearest.select("dir"), "dir", "left_anti").select("dir", "rows")
    bare = scratch.write(bare, "bare")
    scratch.drop("dirs")
    none = hot_split_join(without, bare, "dir", "rows").select("__id", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("score"), F.lit("none").alias("origin"), F.lit(None).cast("string").alias("license_dir"), F.lit(None).cast("long").alias("from_id"))
    out = mine.unionByName(taken).unionByName(none)
    return out.select(real(F.col("__id")).alias(id_col), "license", "score", "origin", "license_dir", real(F.col("from_id")).alias("license_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents lie at source/lang/thousands/hundreds/id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan_licenses(docs.select("doc_id", "text", path.alias("path")), "path")


def _sql() -> str:
    weights, idf, other = template_weights(TEMPLATES)
    bits, asked, modifiers = telling(TEMPLATES)
    plain = lambda rows: ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    return rf"""
WITH weights(template, term, weight) AS (VALUES {plain(weights)}),
idfs(term, idf, bits) AS (VALUES {plain(_known(idf, other, bits))}),
names(template, license, asked) AS (VALUES {plain([(k, t, asked[k]) for k, (t, _) in enumerate(TEMPLATES)])}),
rows AS (
  SELECT doc_id, coalesce(text, '') AS text,
         concat_ws('/', source, lang, floor(doc_id / 1000)::BIGINT::VARCHAR, floor(doc_id / 100)::BIGINT::VARCHAR) AS dir
  FROM documents),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit FROM rows
  UNION ALL SELECT doc_id, text, -1 FROM rows),
words AS (
  SELECT doc_id, unit, unnest(regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM units),
counts AS (
  SELECT w.doc_id, w.unit, w.term, count(*) * any_value(coalesce(i.idf, {other!r}))::DOUBLE AS x, any_value(coalesce(i.bits, 0))::BIGINT AS bits
  FROM words w LEFT JOIN idfs i ON w.term = i.term GROUP BY ALL),
lengths AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS length, bit_or(bits) AS bits FROM counts GROUP BY ALL),
dots AS (
  SELECT c.doc_id, c.unit, w.template, sum(c.x * w.weight::DOUBLE) AS dot
  FROM counts c JOIN weights w ON c.term = w.term GROUP BY ALL HAVING count(*) > 1),
cosines AS (
  SELECT d.doc_id, d.unit, d.template, round(dot / length, 6) AS score, n.license <> 'proprietary' AS named
  FROM dots d JOIN lengths l ON d.doc_id = l.doc_id AND d.unit = l.unit JOIN names n ON d.template = n.template
  WHERE round(dot / length, 6) >= 0.75 AND (l.bits & n.asked) = n.asked AND (l.bits & {modifiers} | n.asked) = n.asked),
own AS (
  SELECT doc_id, bool_or(unit <= 0) AS is_file,
         max(struct_pack(named := named, score := score, neg := -template)) AS best FROM cosines GROUP BY doc_id),
placed AS (
  SELECT r.doc_id, r.dir, o.is_file, o.best.score AS score, -o.best.neg AS template FROM rows r LEFT JOIN own o ON r.doc_id = o.doc_id),
files AS (
  SELECT dir, max(struct_pack(score := score, neg := -doc_id, template := template)) AS f FROM placed WHERE is_file GROUP BY dir),
near AS (
  SELECT p.doc_id, f.dir AS license_dir, f.f,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY length(f.dir) DESC) AS k
  FROM placed p JOIN files f ON p.template IS NULL AND (p.dir = f.dir OR starts_with(p.dir, f.dir || '/'))),
all_rows AS (
  SELECT p.doc_id, coalesce(p.template, n.f.template) AS template, coalesce(p.score, n.f.score) AS score,
         CASE WHEN p.template IS NOT NULL THEN 'own' WHEN n.doc_id IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
         CASE WHEN p.template IS NOT NULL THEN p.dir ELSE n.license_dir END AS license_dir,
         CASE WHEN p.template IS NOT NULL THEN p.doc_id ELSE -n.f.neg END AS license_id
  FROM placed p LEFT JOIN near n ON p.doc_id = n.doc_id AND n.k = 1)
SELECT a.doc_id, n.license, a.score, a.origin, a.license_dir, a.license_id
FROM all_rows a LEFT JOIN names n ON a.template = n.template
"""


SQL = _sql()

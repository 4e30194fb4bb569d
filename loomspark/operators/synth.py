"""Seeding of texts with instructions, and synthesis of documents from segments (doc_id, id, content, tag, importance, start_pos, has_code, has_math, segment_type)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import BREAK, is_blank, key_concept, ordered_join, strip
from loomspark.operators.hetero import order_key
from loomspark.operators.segment import seedable_chunks

# fixed values: instruction types in their order
INSTRUCTIONS = ["ANALYZE", "CONNECT", "ABSTRACT", "BOUNDARY", "CLASSIFY", "PRIORITIZE", "CODE", "MATH", "NARRATIVE", "TECHNICAL", "SPEAKER_BOUNDARY", "TOPIC_EVOLUTION", "REFERENCE", "AGREEMENT", "DISAGREEMENT", "QUESTION", "ANSWER", "CLARIFICATION", "SUMMARY", "CONCLUSION"]
# fixed values: names and headers of segment types
TYPE_NAMES = {"technical_core": "Technical Deep Dive", "foundational": "Foundational Principles", "example": "Practical Examples", "implementation": "Implementation Journey", "problem_solving": "Challenges and Solutions"}
HINTS = "<processing_hints>\n<ANALYZE>Look for causal relationships</ANALYZE>\n<CONNECT>Link related concepts across time</CONNECT>\n<ABSTRACT>Extract high-level themes</ABSTRACT>\n</processing_hints>"
RULE_BLOCK = "\n        <processing_rules>\n        <segmentation_rule>{split}</segmentation_rule>\n        <reorganization_rule>{order}</reorganization_rule>\n        </processing_rules>\n        \n        "
HEADERS = {"technical_core": "## Technical Implementation", "foundational": "## Core Concepts", "example": "## Examples and Applications", "implementation": "## Implementation Details", "problem_solving": "## Challenges and Solutions"}


def rule_set(split_rule: str = "Split at natural topic boundaries", order_rule: str = "Group by theme and importance") -> dict[str, str]:
    """Plain rules as the two entries that seeding reads."""
    return {"segmentation": split_rule, "reorganization": order_rule}


def seeded_with_rules(c: Column, rules: dict[str, str] | None = None) -> Column:
    """The rules' block, then the chunks with the first, middle and last wrapped in rule tags (the latter two from three chunks on), joined by
    blank lines. An empty text stays; null stays null."""
    rules = rule_set() | (rules or {})
    split_rule, order_rule = rules["segmentation"], rules["reorganization"]
    chunks = seedable_chunks(c)
    n = F.size(chunks)
    wrap = lambda tag, rule, x: F.concat(F.lit(f"<{tag} rule='{rule}'>"), x, F.lit(f"</{tag}>"))
    mid = F.floor(n / 2)

    def mark(x: Column, i: Column) -> Column:
        return F.when(i == 0, wrap("SEGMENT", split_rule, x)).when((n >= 3) & (i == mid), wrap("CONNECT", order_rule, x)).when((n >= 3) & (i == n - 1), wrap("ORGANIZE", order_rule, x)).otherwise(x)

    return F.when(c == "", c).otherwise(F.concat(F.lit(RULE_BLOCK.format(split=split_rule, order=order_rule)), F.array_join(F.transform(chunks, mark), BREAK)))


def seeded_at_random(docs: DataFrame, density: float = 0.1, types: list[str] | None = None, seed: int = 7) -> DataFrame:
    """doc_id, text: the hints, then max(1, n * density) chunks of each document, chosen by a hash of document, place and seed, wrapped in a type chosen
    the same way, among the others. Blank and null texts stay."""
    types = types or INSTRUCTIONS
    rows = docs.select("doc_id", "text", F.posexplode_outer(F.when(~is_blank(F.col("text")), seedable_chunks(F.col("text")))).alias("ord", "chunk"))
    per = Window.partitionBy("doc_id")
    k = F.greatest(F.lit(1), F.floor(F.count("chunk").over(per) * density))
    rows = rows.withColumn("take", F.row_number().over(per.orderBy(order_key("doc_id", "ord", seed=seed), "ord")) <= k)
    draw = F.conv(F.substring(order_key("doc_id", "ord", seed=seed + 1), 1, 8), 16, 10).cast("long") % len(types)
    tag = F.element_at(F.lit(types), (draw + 1).cast("int"))
    part = F.when(F.col("take"), F.concat(F.lit("<"), tag, F.lit(">"), "chunk", F.lit("</"), tag, F.lit(">"))).otherwise(F.col("chunk"))
    out = rows.withColumn("part", part).groupBy("doc_id").agg(ordered_join(["ord"], F.col("part"), BREAK).alias("seeded"), F.first("text").alias("text"), F.count("chunk").alias("n"))
    return out.select("doc_id", F.when(F.col("n") > 0, F.concat(F.lit(HINTS + BREAK), "seeded")).otherwise(F.col("text")).alias("text"))


def rule_prompt(rule: Column, text: Column) -> Column:
    return F.concat(F.lit("Rule: "), rule, F.lit("\n\nText: "), text)


def _active(segments: DataFrame) -> DataFrame:
    return segments.filter(F.coalesce("tag", F.lit("")) != "DELETE")


def executive_summary(segments: DataFrame, most: int = 5) -> DataFrame:
    rows = _active(segments)
    per = Window.partitionBy("doc_id")
    rank = F.row_number().over(per.orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), "start_pos", "id"))
    rows = rows.withColumns({"n": F.count("*").over(per), "k": rank}).filter(F.col("k") <= most)
    part = F.concat(F.lit("## "), "id", F.lit("\n"), "content", F.lit("\n"))
    head = F.concat(F.lit("# Executive Summary\n\nThis document summarizes "), F.first("n").cast("string"), F.lit(" key concepts, focusing on the most critical insights.\n\n"))
    return rows.groupBy("doc_id").agg(F.concat(head, ordered_join(["k"], part, "\n")).alias("text"))


def tutorial(segments: DataFrame) -> DataFrame:
    rows = _active(segments).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("start_pos", F.lit(0)), "id")))
    step = F.concat(F.lit("## Step "), F.col("k").cast("string"), F.lit(": "), "id", F.lit("\n\n\n"), "content", F.when(F.col("has_code"), F.lit("\n\n\n*Example Code Block Included*")).otherwise(""))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("# Tutorial\n\n\n"), ordered_join(["k"], step, BREAK)).alias("text"))


def _kind() -> Column:
    return F.when(F.col("has_code"), "Code").when(F.col("has_math"), "Math").otherwise("Text")


def reference(segments: DataFrame) -> DataFrame:
    """Groups in the order in which they are first met, segments in their own."""
    rows = _active(segments).withColumn("kind", _kind())
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_pos", "id"))).withColumn("first", F.min("k").over(Window.partitionBy("doc_id", "kind")))
    part = F.concat(F.when(F.col("k") == F.col("first"), F.concat(F.lit("## "), "kind", F.lit(" Segments\n\n"))).otherwise(""), F.lit("### ID: "), "id", F.lit("\n"), "content", F.lit("\n"))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("# Reference Guide\n\n"), ordered_join(["first", "k"], part, "\n")).alias("text"))


def readme(segments: DataFrame) -> DataFrame:
    rows = _active(segments)
    intro = rows.groupBy("doc_id").agg(F.min(F.struct("start_pos", "id", "content")).alias("i"))
    code = rows.filter("has_code").groupBy("doc_id").agg(ordered_join(["start_pos", "id"], F.concat(F.lit("### Feature: "), "id", F.lit("\n"), "content", F.lit("\n")), "\n").alias("code"))
    text = F.concat(F.lit("# Project README\n\n## Overview\n"), "i.content", F.lit("\n"), F.coalesce(F.concat(F.lit("\n## Features & Examples\n\n"), "code"), F.lit("")))
    return intro.join(code, "doc_id", "left").select("doc_id", text.alias("text"))


def type_name(kind: Column) -> Column:
    named = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    for k, v in TYPE_NAMES.items():
        named = F.when(kind == k, v).otherwise(named)
    return named


def narrative(segments: DataFrame) -> DataFrame:
    """Threads by segment type in the order first met, the most important first, with connectors between, then an insight of each thread."""
    rows = segments.withColumn("segment_type", F.coalesce("segment_type", F.lit("general")))
    own = Window.partitionBy("doc_id", "segment_type")
    rows = rows.withColumns({"first": F.min("start_pos").over(own), "k": F.row_number().over(own.orderBy(F.desc("importance"), "start_pos", "id")), "n": F.count("*").over(own)})
    link = F.when(F.col("k") == 1, "").when(F.col("k") == 2, "Let's begin by examining...\n\n").when(F.col("k") == F.col("n"), "Finally, we arrive at...\n\n").when(F.col("k") % 2 == 1, "Continuing our exploration...\n\n").otherwise("This naturally leads us to...\n\n")
    long = F.filter(F.transform(F.split("content", r"\.", -1), strip), lambda s: F.length(s) > 20)
    insight = F.when(F.size(long) > 0, F.element_at(long, 1)).otherwise("Important conceptual development")
    threads = rows.groupBy("doc_id", "segment_type", "first").agg(
        F.concat(F.lit("\n## "), type_name(F.col("segment_type")), F.lit("\n\n\n"), ordered_join(["k"], F.concat(link, "content"), BREAK)).alias("thread"),
        F.min_by(insight, "k").alias("insight"),
    )
    out = threads.groupBy("doc_id").agg(F.count("*").alias("n"), ordered_join(["first", "segment_type"], F.col("thread"), BREAK).alias("threads"), ordered_join(["first", "segment_type"], F.concat(F.lit("- "), "insight"), "\n").alias("insights"))
    intro = F.concat(F.lit("# A Journey Through Connected Concepts\n\nThis narrative explores "), F.col("n").cast("string"), F.lit(" interconnected themes, weaving together technical insights, foundational principles, and practical applications.\n"))
    end = F.concat(F.lit("\n## Synthesis\n\nOur journey through these concepts reveals several key insights:\n\n"), "insights", F.lit("\n\nThese threads weave together to form a comprehensive understanding of the subject matter, each contributing essential perspectives to the whole."))
    return out.select("doc_id", F.concat(intro, F.lit(BREAK), "threads", F.lit(BREAK), end).alias("text"))


def linear(segments: DataFrame) -> DataFrame:
    """Contents by falling importance."""
    rows = _active(segments).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("importance"), "id")))
    return rows.groupBy("doc_id").agg(ordered_join(["k"], F.col("content"), BREAK).alias("text"))


def type_summary(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """A sentence on the number of segments, relationships and types, the most frequent type first."""
    types = segments.groupBy("doc_id", F.coalesce("segment_type", F.lit("general")).alias("t")).agg(F.count("*").alias("c"))
    per = types.groupBy("doc_id").agg(F.sum("c").alias("n"), ordered_join([(-F.col("c")).alias("o"), "t"], F.concat(F.col("c").cast("string"), F.lit(" "), F.lower(type_name(F.col("t")))), ", ").alias("parts"))
    e = edges.groupBy("doc_id").agg(F.count("*").alias("e"))
    return per.join(e, "doc_id", "left").select("doc_id", F.concat(F.lit("This document synthesizes "), F.col("n").cast("string"), F.lit(" interconnected concepts with "), F.coalesce("e", F.lit(0)).cast("string"), F.lit(" relationships. The content includes "), "parts", F.lit(".")).alias("text"))


def reading_context(segments: DataFrame, compat: bool = False) -> DataFrame:
    """doc_id, text: kept segments in tree order, ready for a generator. compat joins them by a backslash and n instead of line feeds."""
    gap = "\\n\\n---\\n\\n" if compat else "\n\n---\n\n"
    return segments.filter("tag = 'KEEP'").groupBy("doc_id").agg(ordered_join(["seg_id"], F.col("content"), gap).alias("text"))


def most_important(segments: DataFrame, most: int = 30) -> DataFrame:
    """The kept segments of most importance in each document, with their type."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("importance"), "id"))
    return segments.filter("tag = 'KEEP'").withColumn("rank", rank).filter(F.col("rank") <= most).withColumn("segment_type", F.when(F.col("has_code"), "technical_core").otherwise("foundational"))


def exported_segments(segments: DataFrame, most: int = 200) -> DataFrame:
    """id, preview (cut at most characters and marked), full_length and flags for a graph export."""
    preview = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.col("content"))
    return segments.select("doc_id", "id", preview.alias("preview"), F.length("content").alias("full_length"), "has_code", "has_math")


def graphml(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, text: one GraphML document a graph; nodes: doc_id, id, tag, importance, content; edges: doc_id, src, dst, edge_type, weight."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    node = F.concat(F.lit('<node id="'), esc(F.col("id")), F.lit('"><data key="tag">'), esc(F.col("tag")), F.lit('</data><data key="content_length">'), F.length("content").cast("string"), F.lit('</data><data key="importance">'), F.coalesce(F.col("importance").cast("string"), F.lit("0.0")), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('"><data key="edge_type">'), F.coalesce(F.col("edge_type").cast("string"), F.lit("0")), F.lit('</data><data key="weight">'), F.coalesce(F.col("weight").cast("string"), F.lit("1.0")), F.lit("</data></edge>"))
    n = segments.groupBy("doc_id").agg(ordered_join(["id"], node, "").alias("n"))
    e = edges.groupBy("doc_id").agg(ordered_join(["src", "dst"], edge, "").alias("e"))
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'
    return n.join(e, "doc_id", "left").select("doc_id", F.concat(F.lit(head), "n", F.coalesce("e", F.lit("")), F.lit("</graph></graphml>")).alias("text"))


# fixed values: openings by segment type, and by a word in the text; a type's opening goes before the words below it
OPENINGS = [
    ("example", None, "\nTo illustrate this concept:\n"),
    ("technical_core", None, "\nFrom a technical perspective:\n"),
    ("contrast", "however", "\nHowever, it's important to note:\n"),
    ("elaboration", None, "\nBuilding on this idea:\n"),
    (None, "question", "\nThis raises an important question:\n"),
]
OTHER_OPENING = "\nFurthermore:\n"
CODE_WORDS = ["```", "def ", "class ", "function ", "import "]
OTHER_HEADER = "## Further Discussion"
SEED_TITLE = "# Knowledge Synthesis\n\n"
SEED_SENTENCE = "This document explores {}, examining their relationships and implications.\n\n"
CONCLUSION = "\n## Conclusion\n\nDocument processing complete.\n"


def opening(kind: Column, text: Column) -> Column:
    """The phrase that leads to a segment."""
    found = [F.when((kind == (k or "")) | F.contains(F.lower(text), F.lit(w)) if w else kind == k, F.lit(phrase)) for k, w, phrase in OPENINGS]
    return F.coalesce(*found, F.lit(OTHER_OPENING))


def formatted(kind: Column, content: Column, concept: Column) -> Column:
    """A segment's text as it stands in a guided document: code and technical parts as they are, examples marked, foundations under their concept."""
    code = F.exists(F.array(*map(F.lit, CODE_WORDS)), lambda w: F.contains(content, w))
    named = (kind == "foundational") & F.coalesce(concept != "", F.lit(False))
    return F.when(code, content).when(kind.isin("example", "illustrative"), F.concat(F.lit("*Example:*\n"), content)).when(named, F.concat(F.lit("**"), concept, F.lit("**\n\n"), content)).otherwise(content)


def listed(words: list[str]) -> str:
    """One; one and two; one, two, and three."""
    return " and ".join(words) if len(words) < 3 else ", ".join(words[:-1]) + f", and {words[-1]}"


def guided_document(nodes: pd.DataFrame, links: dict[str, list[str]], seed: str = "") -> tuple[list[str], str]:
    """Order and text of a guided document: each time the best unvisited neighbour of what has been visited, else the most important one left.

    nodes: id, importance, segment_type, content, formatted, opening. Score: .3 importance + .4 a link to a visited node + .2 for the section's type +
    the keyword overlap (functions.text) of the text written so far. Ties go to the smaller id. A header follows a segment of another type than the section's, or beyond 50 lines.
    """
    rows = {r.id: r for r in nodes.itertuples()}
    rest = iter(sorted(rows, key=lambda i: (-rows[i].importance, i)))
    heads = {i: set(r.content.lower().split()[:50]) for i, r in rows.items()}
    linked_from: dict[str, list[str]] = {}
    for i, ends in links.items():
        for j in ends:
            linked_from.setdefault(j, []).append(i)
    seen, near, met, order, section, lines = set(), set(), Counter(), [], "introduction", seed.count("\n")
    parts, tail = [seed], seed.lower().split()
    while len(order) < len(rows):
        written = set(tail[-100:]) if order else set()
        score = lambda i: 0.3 * rows[i].importance + 0.4 * met[i] + 0.2 * (rows[i].segment_type == section) + (min(len(written & heads[i]) / 10, 0.3) if order else 0)  # noqa: B023, E731
        pick = max(near, key=lambda i: (score(i), [-ord(c) for c in i])) if near else next(i for i in rest if i not in seen)
        seen.add(pick)
        order.append(pick)
        met.update(linked_from.get(pick, []))
        near.discard(pick)
        near.update(j for j in links.get(pick, []) if j not in seen)
        r = rows[pick]
        added = [r.opening, r.formatted]
        lines += sum(x.count("\n") + 1 for x in added)
        if r.segment_type != section or lines >= 50:
            added.append(f"\n{HEADERS.get(r.segment_type, OTHER_HEADER)}\n")
            section = r.segment_type
            lines += added[-1].count("\n") + 1
        parts += added
        tail = (tail + [w for x in added for w in x.lower().split()])[-100:]
    return order, "\n".join([*parts, CONCLUSION])


def guided(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, text: the guided document, one graph a task. The walk is sequential by its nature, so it runs in pandas; a segment's type is general where it is null."""
    both = edges.select("doc_id", "src", "dst").unionByName(edges.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    lists = both.groupBy("doc_id", F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("links"))
    kind = F.coalesce("segment_type", F.lit("general"))
    rows = segments.select("doc_id", "id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("importance", F.lit(0.0)).alias("importance"), kind.alias("segment_type"))
    rows = rows.withColumn("concept", key_concept(F.col("content")))
    rows = rows.withColumn("formatted", formatted(F.col("segment_type"), F.col("content"), F.col("concept"))).withColumn("opening", opening(F.col("segment_type"), F.col("formatted")))
    rows = rows.join(lists, ["doc_id", "id"], "left")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = set(pdf.id)
        links = {r.id: [j for j in (r.links if r.links is not None else []) if j in ids] for r in pdf.itertuples()}
        base = [r for r in pdf.sort_values("id").itertuples() if r.segment_type == "foundational"] or list(pdf.sort_values(["importance", "id"], ascending=[False, True]).itertuples())
        concepts = [r.concept for r in base[:3] if r.concept]
        seed = SEED_TITLE + (SEED_SENTENCE.format(listed(concepts)) if concepts else "")
        return pd.DataFrame({"doc_id": [pdf.doc_id.iloc[0]], "text": [guided_document(pdf, links, seed)[1]]})

    return rows.groupBy("doc_id").applyInPandas(write, "doc_id long, text string")


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {"executive_summary": executive_summary, "tutorial": tutorial, "reference": reference, "readme": readme}


def register_strategy(name: str, strategy: Callable[[DataFrame], DataFrame]) -> None:
    STRATEGIES[name] = strategy


def reassemble(segments: DataFrame, strategy: str) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](segments)


BUILDERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"guided": guided, "linear": lambda s, e: linear(s), "narrative": lambda s, e: narrative(s)}


def build_document(segments: DataFrame, edges: DataFrame, strategy: str = "guided") -> DataFrame:
    """doc_id, text by the named builder; a name that isn't known goes to the guided one."""
    return BUILDERS.get(strategy, guided)(segments, edges)


def reconstruction_report(texts: DataFrame, segments: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, original_length, strategies (name to length and share of the original, by name), nodes, edges, kept.

    texts: doc_id, strategy, original, text. A document without a text of some strategy lacks its entry; without edges it has 0.
    """
    size = F.length(F.coalesce("text", F.lit("")))
    whole = F.length(F.coalesce("original", F.lit("")))
    each = F.struct("strategy", size.alias("length"), F.when(whole > 0, size / whole).alias("ratio"))
    rows = texts.groupBy("doc_id").agg(F.max(whole).alias("original_length"), F.array_sort(F.collect_list(each)).alias("strategies"))
    n = segments.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("tag") == "KEEP").alias("kept"))
    return rows.join(n, "doc_id", "left").join(edges.groupBy("doc_id").agg(F.count("*").alias("edges")), "doc_id", "left").na.fill(0, ["nodes", "kept", "edges"])


def exported_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, src, dst, weight (1.0 where there is none), type (unknown), edge_type_name (of a dimension edge_type, name; that of 0 where there is none)."""
    rows = edges.withColumn("edge_type", F.coalesce("edge_type", F.lit(0)).cast("int")).join(F.broadcast(names.select("edge_type", "name")), "edge_type", "left")
    return rows.select("doc_id", "src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("type", F.lit("unknown")).alias("type"), F.col("name").alias("edge_type_name"))


def exported_structure(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, nodes, edges, tags and edge_types (name and count, sorted) of a graph export."""
    counts = lambda df, c: df.groupBy("doc_id", c).agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct(F.col(c).alias("name"), "n"))).alias("by"))
    s = counts(segments, "tag").select("doc_id", F.col("all").alias("nodes"), F.col("by").alias("tags"))
    e = counts(edges, "edge_type_name").select("doc_id", F.col("all").alias("edges"), F.col("by").alias("edge_types"))
    return s.join(e, "doc_id", "left").na.fill(0, ["edges"])


# fixed values: instruction types by conversation mode
MODES = {
    "timeline": ["SPEAKER_BOUNDARY", "BOUNDARY", "NARRATIVE"],
    "speaker": ["SPEAKER_BOUNDARY", "QUESTION", "ANSWER"],
    "evolution": ["TOPIC_EVOLUTION", "REFERENCE", "CLARIFICATION"],
    "topics": ["ABSTRACT", "CLASSIFY", "TOPIC_EVOLUTION"],
    "consensus": ["AGREEMENT", "DISAGREEMENT", "CONCLUSION"],
}


def seeded_conversation(docs: DataFrame, mode: str = "timeline", density: float = 0.15) -> DataFrame:
    """doc_id, text: chunks seeded with the mode's instruction types, behind a segment-rule mark."""
    out = seeded_at_random(docs, density, MODES.get(mode, ["BOUNDARY", "CONNECT"]))
    return out.withColumn("text", F.concat(F.lit("<SEGMENT_RULE>"), "text"))

"""Column functions over text. Unicode-aware where the reading asks for it: (?U) for word classes, (?d) for line ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"
BREAK = "\n\n"
# fixed values
CODE_STARTS = ["def", "class", "function", "import", "from", "var", "let", "const", "public", "private", "return"]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def words(c: Column) -> Column:
    """White-space separated words; none of a blank text."""
    return F.filter(F.split(c, r"(?U)\s+", -1), lambda w: w != "")


def word_set(c: Column) -> Column:
    """Distinct lower-cased runs of word characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def binary_cosine(a: Column, b: Column) -> Column:
    """Cosine of two word sets as 0/1 vectors; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b)))


def few_blank_lines(c: Column) -> Column:
    """Three or more line feeds become two; blank text becomes empty."""
    return F.when(is_blank(c), F.lit("")).otherwise(F.regexp_replace(c, r"\n{3,}", BREAK))


# the patterns of the next two functions are fixed values
def has_code(c: Column) -> Column:
    starts = r"(?md)^\s*(?:" + "|".join(CODE_STARTS) + r")\s+"
    return F.contains(c, F.lit("```")) | c.rlike(starts) | c.rlike(r"(?md)[{};]\s*$")


def has_math(c: Column) -> Column:
    return c.rlike(r"(?d)\\\[.*\\\]|\\\(.*\\\)|[$]{1,2}[^$]+[$]{1,2}|\\\\\w+\{")


def key_concept(c: Column) -> Column:
    """The first bold phrase, else the first sentence if shorter than 100 characters, else null."""
    bold = F.regexp_extract(c, r"(?d)\*\*(.+?)\*\*", 1)
    first = strip(F.split_part(c, F.lit("."), F.lit(1)))
    return F.when(bold != "", bold).when(F.length(first) < 100, first)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ordered_join(order: list[Column | str], text: Column, separator: str) -> Column:
    """Aggregate: text values joined in the order of other columns."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("__text")))), lambda r: r["__text"]), separator)


def keyword_overlap(text: Column, content: Column) -> Column:
    """Words that the last 100 of a text share with the first 50 of another, over ten, at most .3."""
    last, first = words(F.lower(text)), words(F.lower(content))
    tail = F.slice(last, F.greatest(F.size(last) - 99, F.lit(1)), F.lit(100))
    return F.least(F.size(F.array_intersect(F.array_distinct(tail), F.array_distinct(F.slice(first, 1, 50)))) / F.lit(10.0), F.lit(0.3))

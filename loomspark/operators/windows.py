"""Context windows over characters, words and tokens, and the graph between them.

A null text gives no windows (a null array, as a column); empty tables give empty tables; rows that repeat a doc_id are documents of their own only in
column functions, so ids should be unique where windows are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import BREAK, few_blank_lines, is_blank, jaccard, strip, word_set, words

# fixed values
CODE_MARKERS = ["```", "`", "def ", "class ", "import ", "from ", "#!/", "</", "/>", "{}", "[]", "()"]


def packed_paragraphs(c: Column, size: int = 1000) -> Column:
    """Paragraphs packed greedily: a window closes when the next paragraph would take it beyond size (separators aren't counted)."""
    pieces = F.filter(F.transform(F.split(c, BREAK, -1), few_blank_lines), lambda p: ~is_blank(p))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def pack(acc: Column, p: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(p) > size)
        done = F.when(full, F.concat(acc["done"], F.array(few_blank_lines(strip(acc["cur"]))))).otherwise(acc["done"])
        cur = F.when(full | (acc["cur"] == ""), p).otherwise(F.concat(acc["cur"], F.lit(BREAK), p))
        return F.struct(done.alias("done"), cur.alias("cur"))

    return F.aggregate(pieces, start, pack, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(few_blank_lines(strip(a["cur"]))))).otherwise(a["done"]))


def word_windows(c: Column, size: int = 1000) -> Column:
    """Overlapping windows of size // 5 words; long texts overlap less (.15, .20, .25). Needs size >= 5."""
    if size < 5:
        raise ValueError("size has to be at least 5")
    target = size // 5
    ws = words(few_blank_lines(c))
    n = F.size(ws)
    overlap = F.when(n > target * 3, int(target * 0.15)).when(n > target, int(target * 0.20)).otherwise(int(target * 0.25))
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(target) - overlap)
    return F.when(n > 0, F.transform(starts, lambda s: F.array_join(F.slice(ws, s + 1, F.lit(target)), " "))).otherwise(F.array().cast("array<string>"))


def context_windows(docs: DataFrame, size: int = 1000) -> DataFrame:
    """doc_id, win_idx, text: packed paragraphs; word windows where there are none or one that is far too long; the raw text where
    nothing results (an empty or blank text is one window). A null text gives none."""
    docs = docs.filter(F.col("text").isNotNull())
    packed = packed_paragraphs(F.col("text"), size)
    long = (F.size("p") == 1) & (F.length(F.element_at("p", 1)) > size * 1.5)
    chosen = F.when((F.size("p") == 0) | long, word_windows(F.col("text"), size)).otherwise(F.col("p"))
    rows = docs.withColumn("p", packed).withColumn("ws", chosen)
    rows = rows.withColumn("ws", F.when(F.size("ws") > 0, F.col("ws")).otherwise(F.array("text")))
    return rows.select("doc_id", F.posexplode("ws").alias("win_idx", "text"))


def looks_like_code(c: Column) -> Column:
    return F.exists(F.array(*map(F.lit, CODE_MARKERS)), lambda m: F.contains(c, m))


def _ratio(target: float) -> float:
    return min(max(target, 0.15), 0.30)


def window_overlap(a: Column, b: Column, size: int) -> Column:
    """Distinct words that the last quarter of a shares with the first quarter of b; quarters are of size, rounded up and down."""
    tail, head = -(-size // 4), size // 4
    last = F.slice(a, F.greatest(F.size(a) - tail + 1, F.lit(1)), F.lit(tail))
    return F.size(F.array_intersect(F.array_distinct(last), F.array_distinct(F.slice(b, 1, head))))


def percolated(windows: DataFrame, size: int = 1000, target: float = 0.2) -> DataFrame:
    """Windows plus an intermediate one wherever neighbours overlap less than the target: doc_id, win_idx, text, inserted."""
    ratio = _ratio(target)
    order = Window.partitionBy("doc_id").orderBy("win_idx")
    rows = windows.withColumn("w", words(F.col("text"))).withColumn("nw", F.lead("w").over(order))
    k, quarter, half = int(size * ratio), size // 4, size // 2
    tail = F.slice("w", F.greatest(F.size("w") - k + 1, F.lit(1)), F.lit(k))
    head = F.slice("nw", 1, k)
    both = F.when(F.size(tail) + F.size(head) > size, F.concat(F.slice(tail, F.greatest(F.size(tail) - half + 1, F.lit(1)), F.lit(half)), F.slice(head, 1, half))).otherwise(F.concat(tail, head))
    low = window_overlap(F.col("w"), F.col("nw"), size) / F.size("w") < ratio
    enough = (F.size("w") >= quarter) & (F.size("nw") >= quarter)
    between = rows.filter(F.col("nw").isNotNull() & low & enough).select("doc_id", (F.col("win_idx") + 0.5).alias("at"), F.array_join(both, " ").alias("text"), F.lit(True).alias("inserted"))
    every = windows.select("doc_id", F.col("win_idx").cast("double").alias("at"), "text", F.lit(False).alias("inserted")).unionByName(between)
    return every.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("win_idx"), "text", "inserted")


def window_graph(windows: DataFrame, size: int = 1000, target: float = 0.2, alike: float = 0.3) -> DataFrame:
    """doc_id, source, target, weight, overlap, type: each window to the next by overlap, and to the one after it where their
    word sets are alike."""
    ratio = _ratio(target)
    order = Window.partitionBy("doc_id").orderBy("win_idx")
    rows = windows.withColumn("w", words(F.col("text"))).withColumn("ws", word_set(F.col("text")))
    rows = rows.withColumn("nw", F.lead("w").over(order)).withColumn("ns", F.lead("ws", 2).over(order))
    overlap = window_overlap(F.col("w"), F.col("nw"), size)
    near = rows.filter("nw IS NOT NULL").select("doc_id", F.col("win_idx").alias("source"), (F.col("win_idx") + 1).alias("target"), F.least(F.lit(1.0), overlap / F.size("w") / ratio).alias("weight"), overlap.alias("overlap"), F.lit(None).cast("string").alias("type"))
    far = rows.filter("ns IS NOT NULL").withColumn("weight", jaccard(F.col("ws"), F.col("ns"))).filter(F.col("weight") > alike)
    far = far.select("doc_id", F.col("win_idx").alias("source"), (F.col("win_idx") + 2).alias("target"), "weight", F.lit(None).cast("int").alias("overlap"), F.lit("semantic").alias("type"))
    return near.unionByName(far)


def token_windows(docs: DataFrame, size: int = 512, step: float = 0.5, full_only: bool = False) -> DataFrame:
    """doc_id, win_idx, start, n_tokens over white-space tokens. step 0.5 slides by half, 1.0 tumbles, 0.75 is the quick overlap.
    Tails are short windows, or left out with full_only; a text of at most size tokens is one window, an empty one a window of 0 tokens, and a null text gives none."""
    stride = int(size * step)
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", F.size(words(F.col("text"))).alias("n"))
    last = F.col("n") - size if full_only else F.col("n") - 1
    starts = F.when(F.col("n") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)))
    return rows.select("doc_id", "n", F.posexplode(starts).alias("win_idx", "start")).select("doc_id", "win_idx", "start", F.least(F.lit(size), F.col("n") - F.col("start")).alias("n_tokens"))

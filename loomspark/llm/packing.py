"""Best-fit packing: documents' token pieces into as few sequences of bounded length as can be.

Hierarchical residual packing. Full pieces are sequences by themselves. The others are dealt into groups of bounded
size and packed best-fit decreasing; bins that are nearly full are final. The emptiest bins of each group, a bounded
number, go on as items to the next round, where `fan_in` groups meet in one and are packed best-fit again, until one group is left.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, text_bytes
from loomspark.llm.tokens import codec, vocabulary

PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


def best_fit(lengths: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing; ties in the order given. Returns each item's bin and its offset there."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r is open
    made = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets


def _pieces_udf(path: str, kind: str, end_id: int, capacity: int):
    end = end_id.to_bytes(4, "little")

    @F.arrow_udf(PIECES)
    def pieces(texts: pa.Array) -> pa.Array:
        c = codec(path, kind)
        out = []
        for t in texts:
            ids = c.ids(t.as_py()) + end
            n = len(ids) // 4
            first = n % capacity or capacity
            cuts = [0, *range(first, n + 1, capacity)]
            out.append([{"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])} for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])
        return pa.array(out, pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])))

    return pieces


def token_pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document: id, piece, start, length, ids_crc32.

    A document longer than capacity is cut into pieces of capacity tokens of which the first may be shorter.
    Null or empty text: the end id alone. Other columns of docs stay out.
    """
    cut = _pieces_udf(tokenizer, kind, end_id, capacity)
    return docs.select(F.col(id_col), F.explode(cut(text_bytes(text_col))).alias("__p")).select(id_col, "__p.*")


def _round(capacity: int, carry: int, nearly: int, last: bool):
    def pack(table: pa.Table) -> pa.Table:
        """One group: its bins (at first one for each piece) are packed into new bins, named by their smallest uid."""
        order = np.lexsort((table["offset"].to_numpy(), table["bin"].to_numpy()))
        table = table.take(pa.array(order))
        old, length = table["bin"].to_numpy(), table["length"].to_numpy()
        names, first, inverse = np.unique(old, return_index=True, return_inverse=True)
        fills = np.add.reduceat(length, first)
        to, base = best_fit(fills.tolist(), capacity)
        to, base = np.array(to), np.array(base)
        n = to.max() + 1
        name = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(name, to, names)
        fill = np.bincount(to, fills, n).astype(np.int64)
        go_on = np.zeros(n, bool)
        if not last:
            emptiest = np.lexsort((name, fill))[:carry]
            go_on[emptiest[fill[emptiest] < nearly]] = True
        at = to[inverse]
        for col, values in (("offset", table["offset"].to_numpy() + base[inverse]), ("bin", name[at]), ("done", ~go_on[at])):
            table = table.set_column(table.column_names.index(col), table.schema.field(col), pa.array(values))
        return table

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_rows: int = 50_000, fan_in: int = 8, carry: int = 512, nearly_full: float = 0.995) -> DataFrame:
    """pieces (with a column length, 1 to capacity) plus sequence_id and offset. Every row is placed.

    No group holds more than about group_rows pieces, or in later rounds fan_in * carry bins. Ties go by the order of
    the written rows. Columns named uid, bin, grp, done, sequence_id or offset are replaced. Null or impossible lengths are an error.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    kept = [c for c in pieces.columns if c not in ("uid", "bin", "grp", "done", "sequence_id", "offset")]
    rows = scratch.write(pieces.select(*kept).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    bad = rows.filter(F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity))
    if bad.limit(1).count():
        raise ValueError(f"lengths have to be between 1 and {capacity}")
    full = F.col("length") == capacity
    done = [rows.filter(full).select(*kept, (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = rows.filter(~full)
    groups = max(1, math.ceil(rest.count() / group_rows))
    rest = rest.withColumns({"bin": F.col("uid"), "offset": F.lit(0).cast("long"), "done": F.lit(False), "grp": F.pmod(F.xxhash64("uid"), F.lit(groups))})
    while True:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields]
        packed = rest.groupBy("grp").applyInArrow(_round(capacity, carry, int(capacity * nearly_full), groups == 1), ", ".join(fields))
        packed = scratch.write(packed, f"round{groups}")
        done.append(packed.filter("done").select(*kept, (F.col("bin") * 2 + 1).alias("sequence_id"), "offset"))
        if groups == 1:
            break
        groups = math.ceil(groups / fan_in)
        rest = packed.filter("not done").withColumn("grp", F.pmod(F.col("grp"), F.lit(groups)))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_documents(docs)


def packed_documents(docs: DataFrame) -> DataFrame:
    pieces = token_pieces(docs, vocabulary("byte_bpe_50k.json"), "bytes", end_id=0)
    return pack_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

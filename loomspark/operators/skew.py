"""Joins whose hot keys don't meet in one task, and ranks without a task that sees all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.scratch import cutter


def hot_split_join(left: DataFrame, right: DataFrame, key: str, rows: str, most_hot: int = 512, most_broadcast: int = 50_000) -> DataFrame:
    """Inner join on key where right has one row for each key, and counts left's rows for it in `rows`.

    Up to most_broadcast rows of right, which are counted, all go by broadcast. Beyond, keys with at least 1/most_hot of all matched rows do: there can
    be at most most_hot of them, so either broadcast has a fixed bound. All other keys are shuffled; each holds less than that share.
    Both frames should be written tables, since each is read twice. Null keys match nothing.
    """
    count, total = right.agg(F.count("*"), F.coalesce(F.sum(rows), F.lit(0))).first()
    if count <= most_broadcast:
        return left.join(F.broadcast(right), key)
    hot = F.col(rows) * F.lit(most_hot) >= F.lit(total)
    hot_rows = right.filter(hot)
    by_broadcast = left.join(F.broadcast(hot_rows), key)
    rest = left.join(F.broadcast(hot_rows.select(key)), key, "left_anti").join(right.filter(~hot), key)
    return by_broadcast.unionByName(rest)


def ranked_rows(rows: DataFrame, order: list[str], place: str, part_rows: int = 1 << 16, most_parts: int = 10_000) -> DataFrame:
    """rows plus place: the number (from 0) of each in the given order.

    Rows are dealt by sampled bounds of the order to as many ranges as their count asks for, so sparse, dense and hot keys all make even ranges, and are numbered
    within them; only counts, of most_parts ranges at most, are added up in one task. The dealt rows are written once, as a second sampling might deal otherwise.
    """
    parts = max(1, min(most_parts, math.ceil(rows.count() / part_rows)))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    dealt = cutter(rows.sparkSession, "ranked")(dealt.withColumns({"__range": F.shiftright("__m", 33), "__at": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}), "dealt")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    base = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__range", base.alias("__base"))
    return dealt.join(F.broadcast(counts), "__range").withColumn(place, F.col("__base") + F.col("__at")).drop("__range", "__at", "__m", "__base")


def running_totals(rows: DataFrame, key: str, value: str, before: str, part_rows: int = 1 << 16, most_parts: int = 10_000) -> DataFrame:
    """rows plus before: the sum of value over all rows with a smaller key (keys are distinct). Ranges as in ranked_rows; only their sums are added up in one task."""
    parts = max(1, min(most_parts, math.ceil(rows.count() / part_rows)))
    dealt = cutter(rows.sparkSession, "totals")(rows.repartitionByRange(parts, key).withColumn("__range", F.spark_partition_id()), "dealt")
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("__range").agg(F.sum(value).alias("__sum")).select("__range", earlier(Window.orderBy("__range"), "__sum").alias("__base"))
    own = dealt.withColumn("__own", earlier(Window.partitionBy("__range").orderBy(key), value))
    return own.join(F.broadcast(sums), "__range").withColumn(before, F.col("__base") + F.col("__own")).drop("__range", "__base", "__own")

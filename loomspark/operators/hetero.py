"""Heterogeneous graphs as edge tables (src, dst): neighbour index, sampling, mini-batches, splits and metrics. Samples follow hashes, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators.graph import listed_by
from loomspark.operators.skew import ranked_rows
from loomspark.sources.tapes import csv_without_header


def order_key(*cols: Column | str, seed: int = 0) -> Column:
    """A repeatable shuffle key, the same on every engine."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols], F.lit(str(seed))).cast("binary"))


def neighbor_index(edges: DataFrame, part_rows: int = 1 << 20) -> DataFrame:
    """dst, part, neighbors: all sources, duplicates kept, sorted. A hub's come in parts by hash, each of about part_rows; others have part 0 alone."""
    return listed_by(edges.select("dst", "src"), "dst", "src", part_rows).withColumnRenamed("src", "neighbors")


def fan_out(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most k sources of each node."""
    rank = F.row_number().over(Window.partitionBy("dst").orderBy(order_key("src", "dst", seed=seed), "src"))
    return edges.withColumn("__k", rank).filter(F.col("__k") <= k).drop("__k")


def mini_batch(seeds: DataFrame, edges: DataFrame, fan_outs: list[int], seed: int = 0) -> DataFrame:
    """id, hop (the first on which a node is met): each hop samples from the nodes that the hop before it found."""
    met, frontier = seeds.select("id", F.lit(0).alias("hop")), seeds.select("id").distinct()
    for hop, k in enumerate(fan_outs, 1):
        own = edges.join(frontier.withColumnRenamed("id", "dst"), "dst", "left_semi")
        frontier = fan_out(own, k, seed + hop).select(F.col("src").alias("id")).distinct()
        met = met.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return met.groupBy("id").agg(F.min("hop").alias("hop"))


def places(nodes: DataFrame) -> DataFrame:
    """id, idx: the place of each distinct id in their order, from 0."""
    return ranked_rows(nodes.select("id").distinct(), ["id"], "idx")


def batch_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges among a batch's nodes with their places in it (by id): src, dst, src_idx, dst_idx."""
    placed = places(nodes)
    a = placed.select(F.col("id").alias("src"), F.col("idx").alias("src_idx"))
    b = placed.select(F.col("id").alias("dst"), F.col("idx").alias("dst_idx"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "src_idx", "dst_idx")


def synthetic_relations(spark: SparkSession, papers: int) -> dict[tuple[str, str, str], DataFrame]:
    """Edge tables (src, dst) of a batch of that many papers with made-up authors and fields: max(10, n // 10) authors, max(5, n // 20) fields, paired by
    remainders, and each relation's reverse. None without papers."""
    authors, fields = max(10, papers // 10), max(5, papers // 20)
    edge = lambda n, dst: spark.range(min(n, papers)).select(F.col("id").alias("src"), dst.alias("dst"))
    back = lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    writes = edge(authors, F.col("id") % max(1, papers))
    topics = edge(fields, F.col("id") % fields)
    return {
        ("author", "writes", "paper"): writes,
        ("paper", "written_by", "author"): back(writes),
        ("paper", "has_topic", "field_of_study"): topics,
        ("field_of_study", "topic_of", "paper"): back(topics),
    }


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among nodes (id), each once."""
    n = nodes.select("id").distinct()
    a = n.select(F.col("id").alias("src"), F.lit(True).alias("__a"))
    b = n.select(F.col("id").alias("dst"), F.lit(True).alias("__b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").filter("__a OR __b").drop("__a", "__b")


def batches(nodes: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """id, batch: slices of size nodes, by id or shuffled. Places come from ranges of the key, so no task orders all nodes, however the ids are spread."""
    key = F.lpad(F.hex("id"), 16, "0") if seed is None else order_key("id", seed=seed)
    placed = ranked_rows(nodes.select("id", key.alias("k")), ["k", "id"], "__r")
    return placed.select("id", F.floor(F.col("__r") / size).alias("batch"))


def split(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """id, part: 80 % train, 10 % valid, 10 % test by a hash of the id alone, so nodes keep their part as others come."""
    bucket = F.conv(F.substring(order_key("id", seed=seed), 1, 4), 16, 10).cast("int") % 10
    return nodes.select("id", F.when(bucket < 8, "train").when(bucket == 8, "valid").otherwise("test").alias("part"))


def official_split(spark: SparkSession, folder: str) -> DataFrame | None:
    """id, part from the files train, valid and test (.csv or .csv.gz, one id a line, no header) of a folder, or None where it doesn't exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    parts = [csv_without_header(spark, f"{folder}/{p}.csv*", "id long").withColumn("part", F.lit(p)) for p in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def split_or_official(nodes: DataFrame, folder: str, seed: int = 42) -> DataFrame:
    """The official split of the nodes (those it doesn't name have none), or split() without one."""
    official = official_split(nodes.sparkSession, folder)
    return split(nodes, seed) if official is None else nodes.select("id").join(official, "id")


def cached_fetch(cached: DataFrame, stored: DataFrame, ids: DataFrame) -> DataFrame:
    """place, id, from_cache and the features of the asked ids (id, place): from the cache where it has them, else from the store.

    cached and stored have id and the same other columns; an id that neither has keeps nulls. Places keep the order of the request.
    """
    kept = [c for c in stored.columns if c != "id"]
    held = F.struct(*[F.col(c) for c in kept])
    rows = ids.select("place", "id").join(cached.select("id", held.alias("__c")), "id", "left")
    missing = rows.filter("__c IS NULL").select("id").distinct()
    rows = rows.join(stored.join(missing, "id", "left_semi").select("id", held.alias("__s")), "id", "left").withColumn("__f", F.coalesce("__c", "__s"))
    return rows.select("place", "id", F.col("__c").isNotNull().alias("from_cache"), *[F.col(f"__f.{c}").alias(c) for c in kept])


def fetch(features: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the asked ids (id, place), in no order; ids without a row keep nulls."""
    return ids.join(features, "id", "left")


def cache_report(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """calls, nodes, hits, hit_rate (hits over calls, so it may exceed 1; null without calls) of requests (call, id)."""
    rows = requests.join(cached.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    return rows.agg(F.count_distinct("call").alias("calls"), F.count("*").alias("nodes"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")).withColumn("hit_rate", F.try_divide("hits", "calls"))


def training_metrics(steps: DataFrame) -> DataFrame:
    """loss (weighed by samples), mean_seconds, samples_per_second of steps (loss, samples, seconds); a rate over nothing is null."""
    return steps.agg(F.try_divide(F.sum(F.col("loss") * F.col("samples")), F.sum("samples")).alias("loss"), F.avg("seconds").alias("mean_seconds"), F.try_divide(F.sum("samples"), F.sum("seconds")).alias("samples_per_second"))


def accuracy(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg((predicted == actual).cast("double")).alias("accuracy"))

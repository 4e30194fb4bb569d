"""Exact top-k search by inner product: columnar branch-and-bound over blocks of vectors.

Base and queries become blocks in vertical layout (a row of numbers for each dimension). A grid joins each group of
base blocks with each group of queries; within a cell a query adds up its scores dimension block by dimension block and keeps,
after each, only the candidates whose score so far plus the most that the remaining mass allows reaches the k-th best
lower bound. Each cell gives k rows a query, which are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch

BLOCK = "grp long, query boolean, n int, dim int, ids binary, mat binary"
FOUND = "query_id long, vec_id long, score long"


def _blocks(is_query: bool, groups: int, most: int):
    def pack(batches):
        """Vectors, each with the group that it belongs to, to vertical blocks."""
        for batch in batches:
            grp, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vecs = batch.column(2)
            sizes = np.diff(vecs.offsets.to_numpy())
            values, at = vecs.values.to_numpy(), vecs.offsets.to_numpy()
            rows: list[list] = [[], [], [], [], [], []]
            for g in np.unique(grp):
                for dim in np.unique(sizes[grp == g]):
                    own = np.flatnonzero((grp == g) & (sizes == dim))
                    for i in range(0, len(own), most):
                        part = own[i : i + most]
                        mat = values[at[part][:, None] + np.arange(dim)[None, :]].T.astype("<i8")
                        for col, x in zip(rows, (g, is_query, len(part), dim, ids[part].astype("<i8").tobytes(), np.ascontiguousarray(mat).tobytes())):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["grp", "query", "n", "dim", "ids", "mat"])

    return pack


def best_of_block(q: np.ndarray, base: np.ndarray, norms: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in base (dim x n) of q's k best with their scores, ties to smaller ids. norms[j]: the root of each
    vector's mass from dimension j * step on. Branch and bound; sums are exact."""
    live = np.flatnonzero(ok)
    score = np.zeros(len(live), base.dtype)
    dim = len(q)
    for j, d in enumerate(range(0, dim, step)):
        part = base[d : d + step] if len(live) == base.shape[1] else base[d : d + step, live]
        score = score + q[d : d + step] @ part
        if d + step < dim and len(live) > k:
            rest = q[d + step :].astype(float)
            most = math.sqrt(float(rest @ rest)) * norms[j + 1][live] * (1 + 1e-9) + 1
            low = score.astype(float) - most
            floor = np.partition(low, len(low) - k)[len(low) - k]
            stay = score.astype(float) + most >= floor
            if stay.sum() < 0.7 * len(live):
                live, score = live[stay], score[stay]
    order = np.lexsort((ids[live], -score))[:k]
    return live[order], score[order]


def _cell(k: int, step: int):
    def search(table: pa.Table) -> pa.Table:
        """All queries of a cell against all its base vectors of their dimension."""
        rows = table.to_pylist()
        out_q, out_v, out_s = [], [], []
        for dim in sorted({r["dim"] for r in rows}):
            own = [r for r in rows if r["dim"] == dim]
            read = lambda q: [(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["mat"], "<i8").reshape(dim, r["n"])) for r in own if r["query"] == q]
            base, asked = read(False), read(True)
            if not base or not asked:
                continue
            ids, mat = np.concatenate([b[0] for b in base]), np.concatenate([b[1] for b in base], axis=1)
            most = float(np.abs(mat).max(initial=0)) * max(float(np.abs(m).max(initial=0)) for _, m in asked) * max(dim, 1)
            if most < 2**52:
                mat = mat.astype(float)  # whole numbers of this size stay exact, and products run in BLAS
            elif most >= 2**62:
                mat = mat.astype(object)  # sums of any size
            squares = mat.astype(float) ** 2
            norms = [np.sqrt(squares[d:].sum(axis=0)) for d in range(0, max(dim, 1), step)]
            for qids, qmat in asked:
                for i, qid in enumerate(qids):
                    at, score = best_of_block(qmat[:, i].astype(mat.dtype), mat, norms, ids != qid, ids, k, step)
                    out_q += [int(qid)] * len(at)
                    out_v += ids[at].tolist()
                    out_s += [int(s) for s in score]
                    if any(abs(s) >= 2**63 for s in out_s[len(out_s) - len(at) :]):
                        raise OverflowError(f"a score of query {qid} doesn't fit a long")
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.int64())], ["query_id", "vec_id", "score"])

    return search


def top_k(base: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, step: int = 16, cell_base: int = 8192, cell_queries: int = 2048) -> DataFrame:
    """Each query's k highest integer inner products of floor(scale * x): query_id, rank, vec_id, score.

    All rows of base but those with the query's own id are candidates; with fewer than k, all are returned. Ties go to
    the smaller id. Vectors that are null or hold null or non-finite components, and rows with a null id, take no part.
    Vectors meet only vectors of their own length. Rows that repeat an id are candidates each; of queries that repeat an
    id one is asked. Sums of any size are exact; a scaled component of 2^62 or more, or one of the k highest scores beyond a long, is an error.
    Other columns stay out. Empty tables give no rows.
    """
    spark = base.sparkSession
    scratch = Scratch(spark, "topk")

    def clean(df: DataFrame) -> DataFrame:
        finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
        out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col)).filter(F.col("id").isNotNull() & F.col(vec_col).isNotNull() & finite)
        large = F.raise_error(F.concat(F.lit("a component is too large in vector "), F.col("id").cast("string"))).cast("long")
        return out.select("id", F.transform(vec_col, lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**62, F.floor(x.cast("double") * scale)).otherwise(large)).alias("v"))

    base, queries = scratch.write(clean(base), "base"), scratch.write(clean(queries).dropDuplicates(["id"]), "queries")
    n_base, n_queries = max(1, math.ceil(base.count() / cell_base)), max(1, math.ceil(queries.count() / cell_queries))

    def grid(df: DataFrame, own: int, other: int, is_query: bool) -> DataFrame:
        """Rows to blocks by group, each block once for every group of the other side."""
        grp = df.select(F.pmod(F.xxhash64("id", "v"), F.lit(own)).cast("long").alias("grp"), "id", "v")
        packed = grp.repartition("grp").mapInArrow(_blocks(is_query, own, 1024), BLOCK) if own > 1 else grp.mapInArrow(_blocks(is_query, own, 1024), BLOCK)
        others = F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("o")
        b, q = (F.col("o"), F.col("grp")) if is_query else (F.col("grp"), F.col("o"))
        return packed.select("*", others).select(b.cast("long").alias("b"), q.cast("long").alias("q"), "query", "n", "dim", "ids", "mat")

    cells = grid(base, n_base, n_queries, False).unionByName(grid(queries, n_queries, n_base, True))
    found = scratch.write(cells.groupBy("b", "q").applyInArrow(_cell(k, step), FOUND), "found")
    scratch.drop("base", "queries")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, b.vec_id, list_dot_product(q.e, b.e)::BIGINT AS score
  FROM v q JOIN v b ON q.vec_id <> b.vec_id AND len(q.e) = len(b.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Operator 5: nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into a grid of cells (query block, candidate slot). In a cell, both
sides are quantised to int8, row by row with its own scale; a matrix product of the int8 tiles gives
approximate distances, and the exact norms of the rounding errors bound how wrong they can be
(triangle inequality). Pairs whose lower bound is no greater than the k-th smallest upper bound
survive; only they are recomputed, in double precision, and a heap keeps the k best of the cell.
The cells' winners meet in a per-query ranking. The bounds make the result exact: recall is 1.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors are
compared with those of the same length only; sizes may be anything finite (only a distance above
the largest double is infinite, and comes last). Ties go to the smaller id; repeated rows are separate
candidates; a query never finds a row of its own id. Empty table: empty result. Extra columns are
not carried. Cells hold about QUERIES queries and CANDIDATES candidates, whatever the input's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, QUERIES, CANDIDATES = 10, 2048, 16384
#: Squares below TINY are no longer exact; what a cell's scale makes smaller than WEAK isn't bounded but recomputed.
TINY, WEAK = 1e-280, 1e-130
SCHEMA = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part."""
    v = F.col("v")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return (
        vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        .where(v.isNotNull() & F.col("vec_id").isNotNull())
        .where(F.forall(v, fine) & F.exists(v, lambda x: x != 0.0))
        .withColumn("dim", F.size(v))
    )


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and a bound for the norm of each row's rounding error."""
    scale = np.abs(m).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(float).tiny
    q = np.clip(np.rint(m / scale[:, None]), -127, 127).astype(np.int8)
    error = np.sqrt(np.square(m - q * scale[:, None]).sum(axis=1))
    return q, scale, error


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten()).reshape(-1, dim)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of a to each row of b; components are added one after another.

    Where squares leave the range of doubles, differences are scaled by the largest one first.
    """
    total = np.zeros(len(b))
    with np.errstate(over="ignore", under="ignore"):
        for i in range(b.shape[1]):
            d = a[i] - b[:, i]
            total += d * d
        out = np.sqrt(total)
        odd = np.flatnonzero(~((total > TINY) & (total < np.inf)))
        if len(odd):
            halves = np.abs(a / 2 - b[odd] / 2)  # of halves: the difference of two finite numbers may not be finite
            top = halves.max(axis=1)
            scaled = halves / np.where(top > 0, top, 1.0)[:, None]
            out[odd] = 2 * (top * np.sqrt(np.square(scaled).sum(axis=1)))
    return out


def search(query_ids: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray, k: int, tile: int = 4096) -> Iterator[tuple[int, int, float]]:
    """The k nearest of each query in one cell, exactly."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    exact = np.float32 if a.shape[1] * 127 * 127 < 2**24 else np.float64  # products of int8 add up exactly
    # all vectors by one power of two, so that none is above 1; those that this makes tiny get no bounds
    power = int(np.frexp(max(np.abs(a).max(), np.abs(b).max()))[1])
    a_scaled = np.ldexp(a, -power)
    weak = np.abs(a_scaled).max(axis=1) < WEAK
    qa, sa, ea = quantised(a_scaled)
    na = np.square(qa.astype(np.float64)).sum(axis=1) * sa * sa
    qa = qa.astype(exact)
    for at in range(0, len(ids), tile):
        part, own = b[at : at + tile], ids[at : at + tile]
        scaled = np.ldexp(part, -power)
        unbound = weak[:, None] | (np.abs(scaled).max(axis=1) < WEAK)[None, :]
        qb, sb, eb = quantised(scaled)
        nb = np.square(qb.astype(np.float64)).sum(axis=1) * sb * sb
        dots = (qa @ qb.astype(exact).T).astype(np.float64)
        near = np.sqrt(np.maximum(na[:, None] + nb[None, :] - 2.0 * sa[:, None] * sb[None, :] * dots, 0.0))
        slack = (ea[:, None] + eb[None, :]) * (1 + 1e-9) + 1e-7 * (np.sqrt(na)[:, None] + np.sqrt(nb)[None, :])
        lows, highs = np.where(unbound, 0.0, near - slack), np.where(unbound, np.inf, near + slack)
        for i, q in enumerate(query_ids):
            low, high = lows[i], highs[i]
            mine = own == q
            if mine.any():
                low[mine] = high[mine] = np.inf
            limit = np.partition(high, k - 1)[k - 1] if len(high) > k else np.inf
            if len(heaps[i]) == k:
                limit = min(limit, np.ldexp(-heaps[i][0][0], -power) * (1 + 1e-9) + WEAK)
            live = np.flatnonzero((low <= limit) & ~mine)
            for d, v in zip(distance(a[i], part[live]).tolist(), own[live].tolist(), strict=True):
                if len(heaps[i]) < k:
                    heapq.heappush(heaps[i], (-d, -v))
                elif (-d, -v) > heaps[i][0]:
                    heapq.heapreplace(heaps[i], (-d, -v))
    for q, heap in zip(query_ids, heaps, strict=True):
        for d, v in heap:
            yield int(q), -v, -d


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors (vec_id, embedding) that is_query picks."""
    rows = usable(vectors)
    n_queries, n = rows.agg(F.count(F.when(is_query, 1)), F.count("*")).first()
    blocks, slots = max(1, -(-n_queries // QUERIES)), max(1, -(-n // CANDIDATES))
    cell = lambda col, size, seed: F.pmod(F.xxhash64(F.col(col), F.lit(seed)), F.lit(size)).cast("int")
    each = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = rows.where(is_query).select("dim", "vec_id", "v", cell("vec_id", blocks, 1).alias("qb"), each(slots).alias("slot"))
    right = rows.select("dim", "vec_id", "v", cell("vec_id", slots, 2).alias("slot"), each(blocks).alias("qb"))
    key = ["dim", "qb", "slot"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if a.num_rows and b.num_rows:
            dim = a.column("dim")[0].as_py()
            found = list(search(np.asarray(a.column("vec_id")), matrix(a.column("v"), dim), np.asarray(b.column("vec_id")), matrix(b.column("v"), dim), k))
        q, v, d = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(d, pa.float64())})

    cells = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, SCHEMA)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

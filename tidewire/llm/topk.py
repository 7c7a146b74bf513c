"""Exact top-k inner products without random access: sorted lists, bounds, early stop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries that meet in one task, and queries that read their lists together.
BLOCK, QUERIES_A_BLOCK, AT_ONCE = 16_384, 4096, 128
#: The part of each list that is read before bounds are first compared; from then on STEP times as far each time.
FIRST, STEP = 128, 4


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _kind(q: np.ndarray, x: np.ndarray) -> type:
    """The narrowest type in which every partial sum is exact."""
    most = 2.0 * q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


class Lists:
    """One list of a block's vectors for each component, sorted by its value; queries read it from the top, or from the bottom where they are negative."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = np.argsort(-x.astype(float), axis=0, kind="stable")
        self.values = np.take_along_axis(x, order, axis=0)
        self.rank = np.empty(x.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)

    def bounds(self, q: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that each query (row) can score with each candidate (column) once t entries of each list are read.

        What is read adds up; an unread entry adds at least its list's worst value, and at most
        the last one read.
        """
        m = len(self.x)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        low, high = 0, 0
        for part, read, worst, last in ((up, self.rank < t, self.values[-1], self.values[t - 1]), (down, self.rank >= m - t, self.values[0], self.values[m - t])):
            known = part @ (self.x * read).T
            unread = (~read).astype(self.x.dtype).T
            low, high = low + known + (part * worst) @ unread, high + known + (part * last) @ unread
        return low, high


def finalists(lists: Lists, q: np.ndarray, other: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
    """For each query the candidates that can be among its k best, and how far it read.

    other: which candidates (columns) count for a query (row). Queries read their lists side by side. Who has
    an upper bound under the k-th best lower bound can't qualify; that holds for unseen candidates too. A
    query stops once few are left; at the lists' ends both bounds are the score.
    """
    m = other.shape[1]
    out: list = [None] * len(q)
    open_, t = np.arange(len(q)), max(1, m // FIRST)
    while len(open_):
        low, high = lists.bounds(q[open_], t)
        low[~other[open_]] = high[~other[open_]] = -np.inf
        need = np.minimum(k, other[open_].sum(axis=1))
        least = -np.partition(-low, min(k, m) - 1, axis=1)[:, : min(k, m)]
        still = []
        for n, i in enumerate(open_):
            limit = np.partition(least[n], len(least[n]) - need[n])[len(least[n]) - need[n]] if need[n] else np.inf
            places = np.flatnonzero(high[n] >= limit)
            if len(places) <= max(4 * k, m // 64) or t == m:
                out[i] = places, t
            else:
                still.append(i)
        open_, t = np.array(still, int), min(m, STEP * t)
    return out


def search_block(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, read: list[float] | None = None) -> list[tuple[int, int, int]]:
    """(query_id, id, score) of the k best of this block for each query, ties to smaller ids.

    Queries read the lists of their components deeper and deeper, AT_ONCE of them side by side, until only
    finalists() are left, whose scores are then resolved. `read` takes the share of the lists that
    each query read. Numbers whose sums doubles don't hold are scored in Python's integers, whole.
    """
    kind = _kind(q, x)
    x, q = x.astype(kind), q.astype(kind)
    lists = Lists(x) if kind is not object and x.shape[1] else None
    out: list[tuple[int, int, int]] = []
    for a in range(0, len(query_ids), AT_ONCE):
        some, other = q[a : a + AT_ONCE], query_ids[a : a + AT_ONCE, None] != ids
        found = finalists(lists, some, other, k) if lists is not None else [(np.flatnonzero(o), len(ids)) for o in other]
        for i, (places, depth) in enumerate(found):
            if read is not None:
                read.append(depth / len(ids))
            best = sorted(zip((-int(s) for s in x[places] @ some[i]), ids[places].tolist(), strict=True))[:k]
            out.extend((int(query_ids[a + i]), v, -s) for s, v in best)
    return out


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(t.num_rows, -1) if t.num_rows else flat.reshape(0, 0)


def _pair(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and rows.num_rows:
            found = search_block(queries.column("vec_id").to_numpy(), _matrix(queries), rows.column("vec_id").to_numpy(), _matrix(rows), k)
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query with all other vectors.

    queries: a condition on id_col that names the query rows. Components are
    floor(256 * x). Blocks of queries meet blocks of candidates, one task a pair; each
    task runs search_block and its k best meet in one window for each query.

    Returns query_id, rank (from 1), vec_id, score; fewer than k rows where there are
    fewer candidates; ties go to the smaller id. Null vectors, vectors with a null or
    non-finite component and null ids take no part; rows that repeat an id all take part,
    as candidates of other ids and as queries; vectors of other lengths than the query's
    are not compared with it (empty ones score 0); very long vectors are compared whole;
    no rows give no rows. Other columns are not read.
    """
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), queries.alias("asks"), quantised(F.col(vector_col)).alias("q"))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    cbs, qbs = max(1, -(-n // BLOCK)), max(1, -(-asking // QUERIES_A_BLOCK))
    # Of equal rows k at most can be among the k best.
    rows = rows.groupBy("vec_id", "q", "asks").agg(F.count("*").alias("n")).withColumn("n", F.explode(F.expr(f"sequence(1, least(n, {k}))")))
    own = lambda blocks, seed: F.pmod(F.xxhash64("vec_id", "q", F.lit(seed)), F.lit(blocks)).cast("int")
    side = rows.select("vec_id", "q", "asks", F.size("q").alias("dim"), own(cbs, 0).alias("own_c"), own(qbs, 1).alias("own_q"))
    cands = side.select("vec_id", "q", "dim", F.col("own_c").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(qbs - 1))).alias("qb"))
    asks = side.where("asks").select("vec_id", "q", "dim", F.col("own_q").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(cbs - 1))).alias("cb"))
    key = ["dim", "qb", "cb"]
    found = asks.groupBy(*key).cogroup(cands.groupBy(*key)).applyInArrow(_pair(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

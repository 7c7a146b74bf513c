"""Similarities of vectors in tiles: a block of one side meets a block of the other in one task, as a matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folding import _runs as runs

#: Rows and probes of a tile, probes of a product, rows of a block of an entity.
ROWS, PROBES, AT_ONCE, SHARING = 4096, 2048, 256, 1024


def usable(vector: Column) -> Column:
    """Vectors that have a similarity: not null, no null or non-finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 where a norm is 0."""
    both = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
    return np.where(both > 0, a @ b.T / np.where(both > 0, both, 1), 0.0)


def best(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the smaller id: in order."""
    if len(sims) > k:
        at = np.flatnonzero(sims >= np.partition(sims, len(sims) - k)[len(sims) - k])
    else:
        at = np.arange(len(sims))
    return at[np.lexsort((ids[at], -sims[at]))][:k]


def _tile(k: int | None, least: float | None):
    """Of each probe of a tile the k most similar rows, or all that are similar enough; never itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in runs(batches, "dim", "qb", "cb"):
            asks, rows = tile[tile["asks"]], tile[~tile["asks"]]
            if not len(asks) or not len(rows):
                continue
            x, ids = np.stack(rows["vector"]), rows["id"].to_numpy()
            for a in range(0, len(asks), AT_ONCE):
                some = asks.iloc[a : a + AT_ONCE]
                sims = cosines(np.stack(some["vector"]), x)
                other = some["id"].to_numpy()[:, None] != ids
                if k is None:
                    i, j = np.nonzero(other & (sims >= least))
                else:
                    places = [np.flatnonzero(o) for o in other]
                    places = [p[best(s[p], ids[p], k)] for p, s in zip(places, sims, strict=True)]
                    i, j = np.repeat(np.arange(len(some)), [len(p) for p in places]), np.concatenate(places)
                yield pd.DataFrame({"probe_id": some["id"].to_numpy()[i], "row_id": ids[j], "similarity": sims[i, j]})

    return run


def met(probes: DataFrame, rows: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """(probe_id, row_id, similarity): probes(probe_id, vector) against rows(row_id, vector), both dealt over blocks.

    A tile is a block of probes and one of rows, so neither a task nor a key grows with the
    tables; a probe is copied once for each block of rows, a row once for each block of probes. With k, the k
    best of each tile come out (the caller takes the k best of those), else all of `least` or more. Vectors
    without a similarity take no part, and lengths that differ don't meet.
    """
    vector = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    asked = probes.where(usable(F.col("vector"))).select(F.col("probe_id").alias("id"), vector, F.lit(True).alias("asks"))
    known = rows.where(usable(F.col("vector"))).select(F.col("row_id").alias("id"), vector, F.lit(False).alias("asks"))
    qbs, cbs = max(1, -(-probes.count() // PROBES)), max(1, -(-rows.count() // ROWS))
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = asked.select("*", F.size("vector").alias("dim"), own(qbs).alias("qb"), every(cbs).alias("cb"))
    known = known.select("*", F.size("vector").alias("dim"), own(cbs).alias("cb"), every(qbs).alias("qb"))
    kind = rows.schema["row_id"].dataType.simpleString()
    both = asked.unionByName(known).repartition("dim", "qb", "cb").sortWithinPartitions("dim", "qb", "cb")
    return both.mapInPandas(_tile(k, least), f"probe_id {kind}, row_id {kind}, similarity double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each probe, ties to the smaller id, with their rank."""
    w = Window.partitionBy("probe_id").orderBy(F.desc("similarity"), F.asc("row_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sharing(least: float, two_sided: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in runs(batches, "entity_id", "ti", "tj"):
            if two_sided:
                x, y = tile[tile["side"] == 0], tile[tile["side"] == 1]
            else:
                ti, tj = tile["ti"].iloc[0], tile["tj"].iloc[0]
                x, y = tile[tile["own"] == ti], tile[tile["own"] == tj]
            if not len(x) or not len(y):
                continue
            v, ids = np.stack(y["vector"]), y["id"].to_numpy()
            for a in range(0, len(x), AT_ONCE):
                some = x.iloc[a : a + AT_ONCE]
                sims, mine = cosines(np.stack(some["vector"]), v), some["id"].to_numpy()
                near = sims >= least
                if not two_sided and ti == tj:
                    near &= mine[:, None] < ids
                i, j = np.nonzero(near)
                one, other = mine[i], ids[j]
                if not two_sided:
                    one, other = np.minimum(one, other), np.maximum(one, other)
                yield pd.DataFrame({"x": one, "y": other, "similarity": sims[i, j]})

    return run


def sharing(x: DataFrame, x_guard: DataFrame, least: float, y: DataFrame | None = None, y_guard: DataFrame | None = None) -> DataFrame:
    """(x, y, similarity, shared): pairs that have entities in common and are similar enough.

    x(id, vector) with x_guard(id, entity_id), against y or, without y, among themselves (each pair once, x < y). An
    entity's rows are dealt over blocks that meet in tiles, and only pairs that are similar enough
    leave a tile: what is sent is the result, once for each shared entity. The products still grow with the
    square of an entity's rows; the ceiling on common entities bounds these to a share of the table.
    """
    vector = F.transform("vector", lambda v: v.cast("double")).alias("vector")
    side = lambda rows, guard, n: rows.where(usable(F.col("vector"))).select("id", vector).join(guard.distinct(), "id").withColumn("side", F.lit(n))
    rows = side(x, x_guard, 0)
    blocks = lambda r: r.groupBy("entity_id").agg(F.ceil(F.count("*") / SHARING).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    if y is None:
        dealt = rows.join(blocks(rows), "entity_id").select("entity_id", "id", "vector", "side", own.alias("own"), every("blocks").alias("o"))
        tiles = dealt.select("entity_id", F.least("own", "o").alias("ti"), F.greatest("own", "o").alias("tj"), "id", "vector", "side", "own")
    else:
        rows_y = side(y, y_guard, 1)
        bx, by = blocks(rows), blocks(rows_y)
        tiles = rows.join(bx, "entity_id").join(by.withColumnRenamed("blocks", "others"), "entity_id").select("entity_id", own.alias("ti"), every("others").alias("tj"), "id", "vector", "side")
        tiles = tiles.unionByName(rows_y.join(by, "entity_id").join(bx.withColumnRenamed("blocks", "others"), "entity_id").select("entity_id", every("others").alias("ti"), own.alias("tj"), "id", "vector", "side"))
        tiles = tiles.withColumn("own", F.lit(0))
    key = ["entity_id", "ti", "tj"]
    found = tiles.repartition(*key).sortWithinPartitions(*key).mapInPandas(_sharing(least, y is not None), "x bigint, y bigint, similarity double")
    return found.groupBy("x", "y").agg(F.first("similarity").alias("similarity"), F.count("*").alias("shared"))

"""An inverted file over vectors: rows in lists by their nearest centroid, probes sent to the lists near them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles, work

#: Rows that centroids are fitted on, rows of a list in the mean, lists at most, rounds of the fit; probes that the share of lists is measured with.
SAMPLE, A_LIST, LISTS, ROUNDS, MEASURED = 65_536, 64, 4096, 8, 256
#: Rows of a list that meet its probes in one task, probes there, vectors whose nearest lists are found at once.
BLOCK, ASKS, AT_ONCE = 4096, 16_384, 512


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def fit(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of a sample by spherical k-means; an empty one starts again at the row that fits worst."""
    x = _unit(x)
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(ROUNDS):
        own = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        worst = np.argsort((x * c[own]).sum(axis=1), kind="stable")
        sums[n == 0] = x[worst[: int((n == 0).sum())]]
        c = _unit(sums)
    return c


class VectorIndex:
    """Lists of all rows by nearest centroid, written in the shared folder; `near` says how many lists a probe asks.

    Centroids are fitted on SAMPLE rows at most, drawn by a hash of the id; every row is in exactly one list.
    `calibrate` measures recall on MEASURED probes at most against the exact search, and sets `near` to the
    smallest number of lists that reaches the recall asked for. Vectors without a similarity are in no list.
    """

    def __init__(self, rows: DataFrame, table, lists: int | None = None):
        spark = rows.sparkSession
        rows = rows.where(tiles.usable(F.col("vector"))).select("row_id", F.transform("vector", lambda v: v.cast("double")).alias("vector"))
        dims = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        self.rows, self.n = rows, rows.count()
        self.dim = dims["dim"] if dims else 0
        sample = rows.where(F.size("vector") == self.dim)
        if self.n > SAMPLE:
            sample = sample.where(F.pmod(F.xxhash64("row_id", F.lit(7)), F.lit(1 << 30)) < int(SAMPLE / self.n * (1 << 30)))
        sample = sample.orderBy(F.xxhash64("row_id", F.lit(11)), "row_id").limit(SAMPLE).toPandas()  # SAMPLE vectors
        want = lists or min(LISTS, max(1, int(np.sqrt(self.n))), max(1, len(sample) // 4))
        self.centroids = fit(np.stack(sample["vector"]), min(want, len(sample))) if len(sample) else np.zeros((0, self.dim))
        self.near = len(self.centroids)
        self._shared = spark.sparkContext.broadcast(self.centroids)  # at most LISTS vectors
        kind = rows.schema["row_id"].dataType.simpleString()
        dealt = self._assigned(rows.where(F.size("vector") == self.dim).select(F.col("row_id").alias("id"), "vector"), kind, 1)
        self.lists = table(dealt.repartition("list"), "list")
        self.kind = kind

    def _assign(self, near: int):
        shared = self._shared

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), AT_ONCE):
                    some = pdf.iloc[a : a + AT_ONCE]
                    sims = _unit(np.stack(some["vector"])) @ shared.value.T
                    at = np.argpartition(-sims, min(near, sims.shape[1]) - 1, axis=1)[:, :near] if near < sims.shape[1] else np.tile(np.arange(sims.shape[1]), (len(sims), 1))
                    yield some.assign(lists=list(at.astype(np.int32)))

        return run

    def _assigned(self, rows: DataFrame, kind: str, near: int) -> DataFrame:
        """rows(id, vector), one for each of the lists nearest to them. Python gives a vector out once, however many lists it asks."""
        found = rows.mapInPandas(self._assign(near), f"id {kind}, vector array<double>, lists array<int>")
        return found.select("id", "vector", F.explode("lists").alias("list"))

    def search(self, probes: DataFrame, k: int, near: int | None = None) -> DataFrame:
        """(probe_id, row_id, similarity, rank): the k best of each probe among the lists nearest to it.

        Lists are dealt over blocks and probes over parts, so one that holds a third of all rows is many tasks.
        """
        near = near or self.near
        asked = probes.where(tiles.usable(F.col("vector"))).select(F.col("probe_id").alias("id"), F.transform("vector", lambda v: v.cast("double")).alias("vector")).where(F.size("vector") == self.dim)
        parts = max(1, -(-asked.count() // ASKS))
        asked = self._assigned(asked, self.kind, near)
        blocks = self.lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cbs"))  # LISTS rows
        # qb: a list and a part of the probes.
        known = self.lists.join(F.broadcast(blocks), "list").select("list", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("id"), "cbs").cast("int").alias("cb"), "id", "vector", F.lit(False).alias("asks"))
        own = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(parts)).cast("int").alias("part")
        asked = asked.join(F.broadcast(blocks), "list").select("list", own, F.explode(F.sequence(F.lit(0), F.col("cbs") - 1)).alias("cb"), "id", "vector", F.lit(True).alias("asks"))
        both = asked.unionByName(known).withColumns({"dim": F.lit(self.dim), "qb": F.col("list").cast("bigint") * parts + F.col("part")}).drop("list", "part")
        both = both.repartition("qb", "cb").sortWithinPartitions("dim", "qb", "cb")
        found = both.mapInPandas(tiles._tile(k, None), f"probe_id {self.kind}, row_id {self.kind}, similarity double")
        return tiles.ranked(found, k)

    def calibrate(self, probes: DataFrame, k: int, recall: float = 0.95) -> float:
        """Set `near` so that a sample of the probes finds this share of its exact k best; returns what was measured."""
        some = probes.orderBy(F.xxhash64("probe_id", F.lit(3)), "probe_id").limit(MEASURED)
        exact = tiles.ranked(tiles.met(some, self.rows, k), k).select("probe_id", "row_id")
        home = exact.join(self.lists.select(F.col("id").alias("row_id"), F.col("list")), "row_id").select("probe_id", "list")
        vectors = some.toPandas()  # MEASURED probes and k of their rows' lists
        found = home.toPandas()
        if not len(found) or not len(self.centroids):
            return 1.0
        v = {i: np.array(x, float) for i, x in zip(vectors["probe_id"], vectors["vector"], strict=True)}
        place = {i: np.argsort(np.argsort(-(self.centroids @ x), kind="stable")) for i, x in v.items() if i in set(found["probe_id"])}
        asked = np.array([place[p][c] for p, c in zip(found["probe_id"], found["list"], strict=True)])
        total = exact.count()
        for near in range(1, len(self.centroids) + 1):
            if (asked < near).sum() >= recall * total:
                break
        self.near = near
        return float((asked < near).sum() / total)


def indexed_nearest(probes: DataFrame, rows: DataFrame, k: int, recall: float = 0.95, lists: int | None = None) -> DataFrame:
    """nearest() by a fresh index, calibrated on the probes; its lists stay for the result."""
    with work.tables(rows.sparkSession) as table:
        index = VectorIndex(rows, lambda df, *by: table(df, *by, keep=True), lists)
        index.calibrate(probes, k, recall)
        return index.search(probes, k)

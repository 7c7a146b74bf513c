"""Greedy decisions in an order, in rounds: which stories are absorbed when older ones go first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: So many undecided pairs or fewer are decided in one task: 16 bytes a pair.
FEW = 1 << 18


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in order of the older end: a pair whose older end is still there absorbs the younger one."""
    gone: dict[int, None] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a not in gone:
                gone[b] = None
    yield pa.RecordBatch.from_arrays([pa.array(list(gone), pa.int64())], names=["b"])


def _chains(left: DataFrame) -> DataFrame:
    """(b, root, odd): nodes with one older neighbour only, followed along such nodes to one with none or several."""
    ones = left.groupBy("b").agg(F.min("a").alias("root"), F.count("*").alias("n")).where("n = 1")
    at = cut(ones.select("b", "root", F.lit(True).alias("odd")))
    while True:
        up = at.select(F.col("b").alias("via"), F.col("root").alias("above"), F.col("odd").alias("odd_above"))
        step = at.join(up, F.col("root") == F.col("via"), "left")
        step = cut(step.select("b", F.coalesce("above", "root").alias("root"), (F.col("odd") != F.coalesce("odd_above", F.lit(False))).alias("odd"), F.col("above").isNotNull().alias("moved")))
        at = step.select("b", "root", "odd")
        if step.where("moved").isEmpty():
            return at


def absorbed(pairs: DataFrame) -> DataFrame:
    """(b): the younger ends that are absorbed, of pairs(a, b, at_a, at_b), a being older, in the order of (at_a, a, at_b, b).

    A story stays if all older ones beside it are absorbed, and is absorbed if one of them stays; an absorbed
    one absorbs nothing. Each round decides all stories without an undecided older neighbour, and their
    younger neighbours; stories that have one such neighbour only form chains, along which
    every other one stays, so a chain takes a round, however long. Once FEW pairs are
    undecided, one task goes through them in order.
    """
    left, gone = cut(pairs.select("a", "b", "at_a").distinct()), None
    while n := left.count():
        if n <= FEW:
            new = left.repartition(1).sortWithinPartitions("at_a", "a").select("a", "b").mapInArrow(_in_order, "b bigint")
            rest = left.limit(0)
        else:
            heads = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
            chains = cut(_chains(left).join(heads.withColumnRenamed("a", "root"), "root", "left_semi"))
            stay = heads.unionByName(chains.where("NOT odd").select(F.col("b").alias("a")))
            new = cut(left.join(stay, "a", "left_semi").select("b").unionByName(chains.where("odd").select("b")).distinct())
            rest = left.join(stay, "a", "left_anti").join(new, "b", "left_anti").join(new.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b", "at_a")
        gone = cut(new if gone is None else gone.unionByName(new))
        left = cut(rest)
    return pairs.select("b").limit(0) if gone is None else gone


def merges(pairs: DataFrame) -> DataFrame:
    """The pairs by which the absorbed ends go: each to the first older one that stays."""
    gone = absorbed(pairs)
    kept = pairs.join(gone, "b", "left_semi").join(gone.withColumnRenamed("b", "a"), "a", "left_anti")
    first = kept.groupBy("b").agg(F.min(F.struct("at_a", "a")).alias("first"))
    return kept.join(first, "b").where((F.col("a") == F.col("first.a"))).drop("first").dropDuplicates(["a", "b"])

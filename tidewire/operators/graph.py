"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: So many edges or fewer between what is left are joined up in one task: 16 bytes an edge.
FEW = 1 << 18


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(work.shared_dir(df.sparkSession))
    return df.checkpoint()


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a few edges with the smallest one of its component, but for that one itself."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in list(up) if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["hi", "root"])


def _followed(label: DataFrame, hooks: DataFrame) -> DataFrame:
    """Labels (hi, root) after further hooks of their roots."""
    up = hooks.toDF("via", "above")
    return cut(label.join(up, F.col("root") == F.col("via"), "left").select("hi", F.coalesce("above", "root").alias("root")).unionByName(hooks))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); a component is named by its smallest node.

    Each round hooks every node to its smallest neighbour, flattens the hooks and carries on
    with the edges between the trees, so rounds are few and edges shrink; once they are FEW, one
    task joins up the rest.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = cut(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    label = None
    kind = e.schema["lo"].dataType.simpleString()
    while left := e.count():
        few = left <= FEW and kind in ("int", "bigint")
        if few:
            hooks = cut(e.select(F.col("lo").cast("bigint"), F.col("hi").cast("bigint")).repartition(1).mapInArrow(_joined_up, "hi bigint, root bigint").select(F.col("hi").cast(kind), F.col("root").cast(kind)))
        else:
            hooks = cut(e.groupBy("hi").agg(F.min("lo").alias("root")))
        while not few:
            up = hooks.toDF("via", "above")
            step = cut(hooks.join(up, F.col("root") == F.col("via"), "left").select("hi", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
            hooks = step.select("hi", "root")
            if step.where("moved").isEmpty():
                break
        if few:
            label = hooks if label is None else _followed(label, hooks)
            break
        a, b = hooks.toDF("node_a", "root_a"), hooks.toDF("node_b", "root_b")
        moved = e.join(a, F.col("lo") == F.col("node_a"), "left").join(b, F.col("hi") == F.col("node_b"), "left")
        moved = moved.select(F.coalesce("root_a", "lo").alias("x"), F.coalesce("root_b", "hi").alias("y"))
        e = cut(moved.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).where("lo < hi").distinct())
        label = hooks if label is None else _followed(label, hooks)
    if label is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(label, F.col("node") == F.col("hi"), "left").select("node", F.coalesce("root", "node").alias("component"))

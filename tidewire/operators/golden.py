"""Recorded answers and what has changed in them since, path by path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import jsons

#: Answers whose leaves are sent on together.
AT_ONCE = 1000


def _paths(volatile: frozenset[str], list_key: str):
    """The status and the leaves of each answer(key, status, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                some, at, paths, values = batch.slice(a, AT_ONCE), [], [], []
                for n, (status, body) in enumerate(zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)):
                    found = jsons.leaves(body, list_key, volatile)
                    if status is not None:
                        found.append(("$status", status))
                    at += [n] * len(found)
                    for path, value in found:
                        paths.append(path)
                        values.append(value)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=["key", "path", "value"])

    return run


def capture(responses: DataFrame, volatile: list[str] | None = None, list_key: str = "id") -> DataFrame:
    """(key, path, value) of responses(key, status, body): a row for the status and one for each leaf of the body.

    What stands under a key of `volatile` is masked, at any depth. Objects in lists are known by their
    `list_key` where all have one of their own, so such lists may come in any order; other lists may not.
    A body that is no JSON is one leaf. To record, write the rows (tables.Snapshots).
    """
    plain = responses.select("key", F.col("status").cast("string").alias("status"), "body")
    schema = T.StructType([plain.schema["key"], T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])
    return plain.mapInArrow(_paths(frozenset(volatile or ()), list_key), schema)


def differences(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(key, path, kind, was, now) where two captures differ: missing, extra or changed; a key that one side lacks has all its paths.

    Rows that repeat a key and path count once if they agree; of others the least value stands. Both sides
    meet in one grouping. A null key is a key like any other.
    """
    none = F.lit(None).cast("string")
    sides = recorded.select("key", "path", F.col("value").alias("was"), none.alias("now")).unionByName(now.select("key", "path", none.alias("was"), F.col("value").alias("now")))
    both = sides.groupBy("key", "path").agg(F.min("was").alias("was"), F.min("now").alias("now")).where(~F.col("was").eqNullSafe(F.col("now")))
    kind = F.when(F.col("was").isNull(), "extra").when(F.col("now").isNull(), "missing").otherwise("changed")
    return both.select("key", "path", kind.alias("kind"), "was", "now")

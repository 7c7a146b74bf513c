"""Vectors of texts without a model: signed feature hashing, weighed by document frequency over the table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import vectors

#: Numbers of a vector; features that tokens are hashed to, which bounds the table of frequencies.
PLACES, FEATURES = 64, 1 << 18
#: Texts that are hashed at once; tokens whose features a task remembers.
AT_ONCE, KNOWN = 500, 1 << 18

_TOKEN = re.compile("[a-z0-9']+")


class _Features(dict):
    """A feature's number for each token, from its md5."""

    def __missing__(self, token: str) -> int:
        self[token] = n = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % FEATURES
        return n


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches whose last column has lower-case texts, with row and feature of each token."""
    known = _Features()
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            some, sizes, found = batch.slice(a, AT_ONCE), [], []
            for body in some.column(some.num_columns - 1).to_pylist():
                tokens = _TOKEN.findall(body)
                sizes.append(len(tokens))
                found.extend(map(known.__getitem__, tokens))
            yield some, np.repeat(np.arange(len(sizes)), sizes), np.array(found, dtype=np.int64)
            if len(known) > KNOWN:
                known.clear()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's rows with each feature, and, as feature -1, all its rows."""
    df, n = np.zeros(FEATURES, dtype=np.int64), 0
    for some, row, feature in _hashed(batches):
        n += some.num_rows
        df += np.bincount(np.unique(row * FEATURES + feature) % FEATURES, minlength=FEATURES)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([n, *df[at]], pa.int64())], names=["feature", "df"])


def _summed(weights, places: int):
    """Each row's id and the sums of its tokens' weights, with their signs, at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = np.arange(FEATURES)
        signed = np.where(feature // places % 2 == 1, 1.0, -1.0) * weights.value
        for some, row, found in _hashed(batches):
            x = np.bincount(row * places + found % places, signed[found], some.num_rows * places).reshape(-1, places)
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c) for c in x.T)], names=["id", *(f"x{i}" for i in range(places))])

    return run


def hashed_vectors(docs: DataFrame, places: int = PLACES) -> DataFrame:
    """(id, vector) of docs(id, text): each token adds or takes its weight at a place of the vector, which then gets unit length.

    A token's feature decides place and sign; its weight is ln((1 + N) / (1 + df)) + 1 over all N documents.
    The texts are read twice: for the frequencies, of which a task sends FEATURES at most, and for the sums, so only
    `places` numbers a document move. Null and empty texts, and texts without tokens, have zeros. Rows of one id
    are one document, null ids too; no rows give no rows.
    """
    rows = docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    got = rows.select("text").mapInArrow(_counted, "feature bigint, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()  # FEATURES + 1 rows at most
    df = np.zeros(FEATURES + 1)
    df[got["feature"].to_numpy(dtype=np.int64)] = got["df"]  # the number of rows comes last
    weights = docs.sparkSession.sparkContext.broadcast(np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1)
    names = [f"x{i}" for i in range(places)]
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *(T.StructField(x, T.DoubleType()) for x in names)])
    sums = rows.mapInArrow(_summed(weights, places), schema).groupBy("id").agg(*(F.sum(x).alias(x) for x in names))
    # Bound once: in the lambda itself the norm would be worked out anew at every place.
    both = F.array(F.struct(F.array(*names).alias("v"), vectors.norm(F.array(*names)).alias("norm")))
    unit = F.transform(both, lambda b: F.transform(b["v"], lambda x: F.when(b["norm"] > 0, x / b["norm"]).otherwise(0.0)))
    return sums.select("id", F.get(unit, F.lit(0)).alias("vector"))

"""Vector functions, JVM-side in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(F.try_divide(dot(a, b), both))


def distance(a: Column, b: Column) -> Column:
    """Cosine distance."""
    return 1 - cosine(a, b)


def moved_mean(mean: Column, members: Column, vector: Column) -> Column:
    """A mean of `members` vectors, the last of them included: each place moves by its share."""
    return F.zip_with(mean, vector, lambda m, x: (m * (members - 1) + x.cast("double")) / members)


def mean_vector(df: DataFrame, key: str, vector: str, out: str = "centroid") -> DataFrame:
    """The exact mean of each key's vectors, summed map-side by place."""
    places = df.select(key, F.posexplode(vector).alias("place", "x"))
    means = places.groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias(out))


def batch_valid(df: DataFrame, batch: str, vector: str, dim: int, tolerance: float = 0.05) -> DataFrame:
    """Each batch with whether all its vectors have dim numbers and a norm of about 1."""
    good = (F.size(vector) == dim) & (F.abs(norm(F.col(vector)) - 1) <= tolerance)
    return df.groupBy(batch).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("accepted"), F.count("*").alias("n"))

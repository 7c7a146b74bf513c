"""The library's functions under names that SQL can call."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jsons, markup, urls


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def mean_of_vectors(vectors: pd.Series) -> np.ndarray:
    """The mean of a group's vectors. A group is held by one task: for large ones vectors.mean_vector sums by place."""
    return np.mean(np.stack(vectors.to_list()), axis=0).tolist()


@F.udtf(returnType="at int, title string, link string, published string, skipped string")
class FeedEntries:
    """A feed document's entries, or what was refused and why."""

    def eval(self, body: str):
        from tidewire.sources.feeds import parse

        for row in parse("", body):
            yield row[1], row[2], row[3] or row[6], row[8], row[11]


SCALARS = {"tw_canonical_url": urls.canonical_url, "tw_html_to_text": markup.html_to_text, "tw_sanitize": markup.sanitize, "tw_mask_keys": jsons.mask_keys, "tw_mean_vector": mean_of_vectors}


def register(spark: SparkSession) -> list[str]:
    """Register all functions with a session; returns their names."""
    for name, f in SCALARS.items():
        spark.udf.register(name, f)
    spark.udtf.register("tw_feed_entries", FeedEntries)
    return [*SCALARS, "tw_feed_entries"]

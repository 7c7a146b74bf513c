"""Bounded samples of labelled rows, to fit a model on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most classes of a sample (more are refused, none is left out), rows of all classes together, and rows of a class at least.
MAX_CLASSES, MOST_ROWS, LEAST_ROWS = 400, 12_000, 30


def bounded_ids(labelled: DataFrame, id_col: str, class_col: str, per_class: int, seed: int) -> DataFrame:
    """About per_class rows (id_col, class_col) of each class, fewer where MOST_ROWS would be passed; twice as many at most.

    Rows are drawn by a hash of the id, so reruns agree. All classes are counted over all
    rows, and each takes part. Rows with a null class are not drawn.
    """
    counts = labelled.where(F.col(class_col).isNotNull()).groupBy(F.col(class_col).alias("of")).agg(F.count("*").alias("rows"))
    found = counts.limit(MAX_CLASSES + 1).count()
    if found > MAX_CLASSES:
        raise ValueError(f"{class_col} has more than {MAX_CLASSES} values")
    per = min(per_class, max(LEAST_ROWS, MOST_ROWS // max(1, found)))
    steps = 1 << 30
    own = labelled.join(F.broadcast(counts), labelled[class_col] == counts["of"])  # MAX_CLASSES rows at most
    own = own.select(id_col, class_col, F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(steps)).alias("draw"), "rows")
    drawn = own.where(F.col("draw") < F.ceil(F.lit(float(steps * per)) / F.col("rows")))
    return drawn.orderBy("draw", id_col, class_col).limit(2 * per * max(1, found)).select(id_col, class_col)

"""Work tables in the shared folder, and small column helpers, for the operators here."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
#: A word of the contracts, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of applications in local mode that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and everything runs in this process (local mode, as in
    tests) is a folder of this machine taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or _own.get(spark.sparkContext.applicationId, "")
    if not folder:
        # The check of the master keeps this off clusters.
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        _own[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


#: Work tables by application that results may still read.
_kept: dict[str, list[str]] = {}


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the written table.

    It cuts the lineage: a lost executor costs the tasks that ran there, not the
    whole history, and several readers share the work. It stays while results may read
    it: scratch() and drop_table() delete.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewire/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(table: DataFrame) -> None:
    """Delete a work table whose readers have all been written themselves."""
    spark = table.sparkSession
    _delete(spark, table.work_path)
    kept = _kept.get(spark.sparkContext.applicationId, [])
    if table.work_path in kept:
        kept.remove(table.work_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes all work tables made meanwhile at the end, but for those passed to what it gives."""
    app, saved = spark.sparkContext.applicationId, []
    before = set(_kept.get(app, []))

    def keep(table: DataFrame) -> DataFrame:
        saved.append(table.work_path)
        return table

    try:
        yield keep
    finally:
        for path in [p for p in _kept.get(app, []) if p not in before and p not in saved]:
            _delete(spark, path)
            _kept[app].remove(path)


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Gives a work_table() whose tables go at the end, but for those made with keep=True: a result reads them."""
    own: list[DataFrame] = []

    def table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        out = work_table(df, name)
        if not keep:
            own.append(out)
        return out

    try:
        yield table
    finally:
        for t in own:
            drop_table(t)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the columns alone, so reruns agree."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression of higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows of whole texts that Python takes at once; an Arrow batch that Spark sends holds 64 MB at most.
TEXTS = 500


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables that are written meanwhile pass so many rows an Arrow batch; the session's own setting then comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)

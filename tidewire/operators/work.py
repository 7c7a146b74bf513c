"""Work tables of rounds: written once in the folder that all executors share, read by later steps, deleted by their owner."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications in local mode that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where everything runs in this process may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or _own.get(spark.sparkContext.applicationId, "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidewire-")
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go with the end of each write (Spark 4.1 on), not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def tables(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Gives table(df, *partition_by), which writes df and reads it back; its tables go at the end, but for those made with keep=True, which a result reads."""
    made: list[str] = []

    def table(df: DataFrame, *partition_by: str, keep: bool = False) -> DataFrame:
        path = f"{shared_dir(spark)}/tidewire/{uuid.uuid4().hex}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
        if not keep:
            made.append(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield table
    finally:
        for path in made:
            delete(spark, path)

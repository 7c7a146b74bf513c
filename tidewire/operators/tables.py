"""Table writes as DataFrame algebra, and versioned snapshots."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import cut


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of base with the same key."""
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_sets(base: DataFrame, new: DataFrame, owner: str, owners: DataFrame) -> DataFrame:
    """All rows of the owners go; new ones come."""
    return base.join(owners.select(owner), owner, "left_anti").unionByName(new)


def update_from(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns that changes has a value for."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    out = base.join(c, key, "left")
    return out.select(*[F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in base.columns])


def with_new_ids(dimension: DataFrame, keys: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """The dimension with rows for keys it lacks; ids go on behind its largest.

    Numbers come from a range-partitioned count, not from one sorted task.
    """
    fresh = keys.select(*key).distinct().join(dimension.select(*key), key, "left_anti")
    return dimension.unionByName(numbered(fresh, [F.col(c) for c in key], id_col, dimension.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]), allowMissingColumns=True)


def numbered(df: DataFrame, order: list[Column], out: str, start: int = 0) -> DataFrame:
    """df with consecutive numbers after `start` in an order, without one task for all rows.

    Rows are dealt by ranges of the order; each range is counted, and its rows are numbered
    behind the ranges before it. Both read one checkpoint, so a lost executor changes no number.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    dealt = cut(dealt)  # its numbers are read twice
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    base = counts.select("_p", "_first", before.alias("_before"))
    return dealt.join(base, "_p").withColumn(out, F.col("_m") - F.col("_first") + F.col("_before") + 1 + F.lit(start)).drop("_p", "_m", "_first", "_before")


class Conflict(RuntimeError):
    """Somebody else committed, or holds the lock, meanwhile: nothing of this write is visible."""


class _Folder:
    """Small files under a path, through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _files(self, folder: str) -> dict[str, int]:
        """Names and sizes."""
        p, fs = self._at(folder)
        return {f.getPath().getName(): f.getLen() for f in fs.listStatus(p)} if fs.exists(p) else {}

    def _create(self, name: str, text: str) -> None:
        """Make a file that nobody else has made; a Conflict otherwise."""
        p, fs = self._at(name)
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                raise Conflict(f"{name} exists already") from e
            raise
        out.write(bytearray(text, "utf-8"))
        out.close()

    def _text(self, name: str) -> list[str]:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0].split("\n")


class Lock(_Folder):
    """A lock with an end and a fencing number, for jobs that run once at a time.

    Each holder's number is one more than the last one's, claimed by creating a file; a holder that
    is late finds a larger number there, and holds() is false. Times are the caller's, in seconds.
    """

    def _last(self) -> tuple[int, float]:
        """The last number, and when it ends."""
        files = self._files("")
        numbers = [int(n.split(".")[0]) for n in files]
        if not numbers:
            return 0, 0.0
        last = max(numbers)
        ends = [n.split(".", 1)[1] for n in files if n.startswith(f"{last}.")]
        return last, 0.0 if "free" in ends else max((int(e) / 1000 for e in ends), default=0.0)

    def acquire(self, now: float, seconds: float) -> int | None:
        """A fencing number, or None while somebody holds the lock."""
        last, end = self._last()
        if end > now:
            return None
        try:
            self._create(f"{last + 1}", "")
        except Conflict:
            return None
        self._create(f"{last + 1}.{int((now + seconds) * 1000)}", "")
        return last + 1

    def holds(self, number: int, now: float) -> bool:
        return self._last()[0] == number and self._last()[1] > now

    def extend(self, number: int, now: float, seconds: float) -> bool:
        """Hold on for longer, if the lock is still held."""
        if not self.holds(number, now):
            return False
        try:
            self._create(f"{number}.{int((now + seconds) * 1000)}", "")
        except Conflict:
            pass
        return True

    def release(self, number: int) -> None:
        if self._last()[0] == number:
            try:
                self._create(f"{number}.free", "")
            except Conflict:
                pass


class Snapshots(_Folder):
    """A table as Parquet folders under one path, with a numbered list of the current ones.

    Rows are written to a folder of their own first; then the next number is claimed by
    creating its list, which one writer only can. So readers and retries see the old or the
    new version, a loser spoils nothing, and an append leaves what is stored alone. What was worked out
    from a version is written with `expected`, or by update(): if another version is there by then,
    the write is refused (Conflict) and nothing is lost. Lists older than `keep` versions go, with the folders that no list kept names. Paths go
    through Spark's file systems.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3, most_folders: int = 64):
        super().__init__(spark, path)
        self.keep, self.most = keep, most_folders

    def _names(self, folder: str) -> list[str]:
        return list(self._files(folder))

    def _versions(self) -> list[int]:
        """Numbers of the versions that are complete."""
        return sorted(int(n) for n, size in self._files("done").items() if size)

    def _drop_abandoned(self, number: int) -> None:
        """Free a number whose writer claimed it and went before it wrote the list, a minute ago or more."""
        p, fs = self._at(f"done/{number}")
        if fs.exists(p) and not fs.getFileStatus(p).getLen() and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > 60:
            fs.delete(p, False)

    def _list(self, version: int) -> list[str]:
        """The tag of a version, then its folders."""
        return self._text(f"done/{version}")

    def version(self) -> int:
        """The current version's number; 0 before the first."""
        return (self._versions() or [0])[-1]

    def read(self, version: int | None = None) -> DataFrame | None:
        version = self.version() if version is None else version
        folders = self._list(version)[1:] if version else []
        return self.spark.read.parquet(*(f"{self.path}/rows/{f}" for f in folders)) if folders else None

    def tag(self) -> str | None:
        """What the current version was committed for."""
        versions = self._versions()
        return self._list(versions[-1])[0] if versions else None

    def write(self, df: DataFrame, tag: str = "", append: bool = False, expected: int | None = None, fence: tuple[Lock, int, float] | None = None) -> int:
        """Commit df as the next version, or as rows added to the current one.

        A Conflict if another writer took the number; with `expected`, the version that df was worked out
        from, also if another one is current; with `fence` (a lock, its number, now), also if the lock is lost.
        """
        last = self.version()
        if expected is not None and last != expected:
            raise Conflict(f"version {last}, not {expected}")
        folders = self._list(last)[1:] if append and last else []
        if len(folders) >= self.most:
            folders, df = [], self.spark.read.parquet(*(f"{self.path}/rows/{f}" for f in folders)).unionByName(df)
        own = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/rows/{own}")
        number = last + 1
        self._drop_abandoned(number)
        try:
            if fence is not None and not fence[0].holds(fence[1], fence[2]):
                raise Conflict(f"lock {fence[1]} is lost")
            self._create(f"done/{number}", "\n".join([tag, *folders, own]))
        except Conflict:
            p, fs = self._at(f"rows/{own}")
            fs.delete(p, True)
            raise
        self._tidy()
        return number

    def update(self, change, tag: str = "", tries: int = 5) -> int:
        """Commit change(current rows), worked out anew from the newest version as often as another writer comes first."""
        for left in range(tries - 1, -1, -1):
            at = self.version()
            try:
                return self.write(change(self.read(at)), tag, expected=at)
            except Conflict:
                if not left:
                    raise

    def _tidy(self) -> None:
        versions = self._versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        named = {f for v in kept for f in self._list(v)[1:]}
        for v in old:
            for f in set(self._list(v)[1:]) - named:
                p, fs = self._at(f"rows/{f}")
                fs.delete(p, True)
            p, fs = self._at(f"done/{v}")
            fs.delete(p, False)

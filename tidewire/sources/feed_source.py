"""Feeds as a Spark data source: a file for each feed in any store that pyarrow.fs opens, as a batch or a stream with a cursor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .feeds import MOST_BYTES

SCHEMA = "feed string, body string, at timestamp"


@dataclass
class Feed(InputPartition):
    """One feed's document, as it was listed."""

    path: str
    changed: str  # time in nanoseconds and size: what a server would call its entity tag


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _listed(path: str) -> dict[str, str]:
    from pyarrow import fs

    store, root = _store(path)
    files = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path: f"{f.mtime_ns or 0}:{f.size}" for f in files if f.is_file and not f.base_name.startswith((".", "_"))}


def _document(path: str, feed: Feed) -> Iterator[tuple]:
    """The feed's row; a body that is too large isn't read and is null, which entries() says."""
    store, _ = _store(path)
    at, size = feed.changed.split(":")
    body = None
    if int(size) <= MOST_BYTES:
        with store.open_input_stream(feed.path) as f:
            body = f.read().decode("utf-8", "replace")
    yield feed.path, body, datetime.fromtimestamp(int(at) / 1e9, timezone.utc)


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Feed]:
        return [Feed(p, c) for p, c in sorted(_listed(self.path).items())]

    def read(self, partition: Feed | None) -> Iterator[tuple]:
        return iter(()) if partition is None else _document(self.path, partition)


class _Stream(DataSourceStreamReader):
    """The offset is what was listed: each feed with its last change. It goes to the checkpoint, so a restart asks for what has changed since."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _listed(self.path)

    def partitions(self, start: dict, end: dict) -> list[Feed]:
        """The feeds that changed: an unchanged one isn't opened."""
        return [Feed(p, c) for p, c in sorted(end.items()) if start.get(p) != c]

    def read(self, partition: Feed) -> Iterator[tuple]:
        return _document(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """spark.dataSource.register(FeedSource), then spark.read or spark.readStream.format("feeds").load(uri): (feed, body, at).

    Each feed is a partition of its own. What is listed, not what is read, passes the driver: a name
    and a change for each feed. A feed that is replaced between listing and reading gives its newer
    body, and comes again with the next batch.
    """

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])

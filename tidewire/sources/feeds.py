"""RSS 2.0 and Atom feeds as rows: parsing, guards against hostile documents, normalised items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import markup, urls

# Items of one document, bytes of one document.
MOST_ITEMS, MOST_BYTES = 200, 2 * 1024 * 1024

RAW = "feed string, at int, title string, link string, guid string, is_permalink boolean, alternate string, body string, published string, author string, images array<string>, skipped string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _first(entry, names: tuple[str, ...]) -> str | None:
    """The text of the first of `names` that is there and not blank; names may say `prefix:name`."""
    for name in names:
        for e in entry:
            full = ("content:" if "purl.org/rss/1.0/modules/content" in e.tag else "dc:" if "purl.org/dc/" in e.tag else "") + _local(e.tag)
            if full == name:
                text = "".join(e.itertext()).strip() or (e.text or "").strip()
                if name == "author" and not text:
                    continue
                if text:
                    return text
    return None


def parse(feed: str, body: str | None) -> list[tuple]:
    """Rows of RAW for one document; an entry that can't be read is a row that says why. Null: a document too large to be read."""
    if body is None or len(body.encode()) > MOST_BYTES:
        return [_skip(feed, -1, "document too large")]
    if re.search(r"<!DOCTYPE|<!ENTITY", body, re.I):
        return [_skip(feed, -1, "document type refused")]
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return [_skip(feed, -1, "malformed document")]
    entries = [e for e in root.iter() if _local(e.tag) == "item"] or [e for e in root.iter() if _local(e.tag) == "entry"]
    out = []
    for at, e in enumerate(entries[:MOST_ITEMS]):
        links = [x for x in e if _local(x.tag) == "link"]
        guid = next((x for x in e if _local(x.tag) == "guid"), None)
        alternate = next((x.get("href") for x in links if x.get("href") and x.get("rel", "alternate") == "alternate"), None)
        images = [x.get("url") for x in e.iter() if _local(x.tag) in ("enclosure", "content", "thumbnail") and x.get("url") and (x.get("type") or "image/").startswith("image/")]
        author = next(("".join(y.itertext()).strip() for x in e if _local(x.tag) == "author" for y in x if _local(y.tag) == "name"), None) or _first(e, ("author", "dc:creator"))
        out.append(
            (
                feed, at, _first(e, ("title",)), next(((x.text or "").strip() for x in links if (x.text or "").strip()), None),
                (guid.text or "").strip() if guid is not None else None, guid is not None and guid.get("isPermaLink", "true").lower() == "true", alternate,
                _first(e, ("content:encoded", "description", "content", "summary")), _first(e, ("pubDate", "published", "updated", "dc:date")), author, images, None,
            )
        )
    return out


def _skip(feed: str, at: int, why: str) -> tuple:
    return (feed, at, None, None, None, None, None, None, None, None, None, why)


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.strip().split()[0] for c in RAW.split(",")]
    for pdf in batches:
        yield pd.DataFrame([r for f, b in zip(pdf["feed"], pdf["body"], strict=True) for r in parse(f, b)], columns=names)


def entries(documents: DataFrame) -> DataFrame:
    """documents(feed, body) -> one row for each entry, or for what was refused."""
    return documents.select("feed", "body").mapInPandas(_parse_batches, RAW)


def parsed_date(raw: Column) -> Column:
    """The usual forms of RFC 822 and ISO 8601 by Spark; Python reads what they leave."""
    mail = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", ""), r"\b(?:GMT|UTC|Z)$", "+0000")
    read = F.coalesce(F.try_to_timestamp(F.when(mail.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), mail), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.when(F.trim(raw).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})$"), F.trim(raw)), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    return F.coalesce(read, parse_date(F.when(read.isNull(), raw)))


@F.pandas_udf(T.TimestampType())
def parse_date(raw: pd.Series) -> pd.Series:
    """RFC 822, then ISO 8601; without a zone UTC; null where neither reads it."""
    from datetime import UTC, datetime
    from email.utils import parsedate_to_datetime

    def one(s):
        for read in (parsedate_to_datetime, lambda x: datetime.fromisoformat(x.replace("Z", "+00:00"))):
            try:
                t = read(s.strip())
                return pd.Timestamp((t if t.tzinfo else t.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None))
            except (ValueError, TypeError, AttributeError, IndexError):
                continue
        return None

    return pd.to_datetime(raw.map(one, na_action="ignore"))


def normalise(raw: DataFrame, now: str, since: str | None = None) -> DataFrame:
    """Items of entries(): canonical URL, visible text, time, authors, images, flags, and why one is skipped.

    The link is the link's text, an alternate link's address, or a guid that is a permalink.
    Where no time is given the item counts as discovered `now`, and says so.
    """
    at = F.lit(now).cast("timestamp")
    link = F.coalesce("link", "alternate", F.when(F.col("is_permalink"), F.col("guid")))
    out = raw.withColumn("original_url", link).withColumn("t", parsed_date(F.col("published"))).withColumn("b", markup.html_to_text("body")).withColumn("h", markup.html_to_text("title"))
    out = out.withColumn("s", markup.sanitize(F.col("b.text"))).withColumn("published_at", F.coalesce("t", at))
    old = F.lit(False) if since is None else F.col("published_at") < F.lit(since).cast("timestamp")
    why = F.coalesce("skipped", F.when(F.col("original_url").isNull(), "no link").when(F.col("h.text") == "", "no title").when(old, "older than the window"))
    from tidewire.functions.text import injection_patterns

    return out.select(
        "feed", "at", urls.canonical_url("original_url").alias("canonical_url"), "original_url", F.col("h.text").alias("title"), F.col("s.text").alias("body_text"),
        "published_at", F.col("t").isNull().alias("timestamp_estimated"), F.when(F.col("author").isNull(), F.array().cast("array<string>")).otherwise(F.array("author")).alias("authors"),
        F.array_distinct(F.coalesce("images", F.array().cast("array<string>"))).alias("image_urls"), injection_patterns(F.col("s.text")).alias("patterns"),
        F.col("b.hidden_blocks").alias("hidden_blocks"), why.alias("skip_reason"),
    )


def read_files(spark: SparkSession, path: str, stream: bool = False, per_trigger: int | None = None, after: str | None = None) -> DataFrame:
    """documents(feed, body, at) from files of any Spark file system, as a batch or a stream.

    A file that is too large has a null body, which entries() turns into a row that says so;
    its content is not read. A stream takes `per_trigger` files at a time at most; a batch may
    leave out files that were not changed since `after`.
    """

    def files() -> DataFrame:
        reader = (spark.readStream if stream else spark.read).format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        if stream and per_trigger:
            reader = reader.option("maxFilesPerTrigger", per_trigger)
        if after and not stream:
            reader = reader.option("modifiedAfter", after)
        return reader.load(path)

    if stream:  # one source, read once
        body = F.when(F.col("length") <= MOST_BYTES, F.decode("content", "UTF-8"))
        return files().select(F.col("path").alias("feed"), body.alias("body"), F.col("modificationTime").alias("at"))
    small = files().where(F.col("length") <= MOST_BYTES).select(F.col("path").alias("feed"), F.decode("content", "UTF-8").alias("body"), F.col("modificationTime").alias("at"))
    large = files().where(F.col("length") > MOST_BYTES).select(F.col("path").alias("feed"), F.lit(None).cast("string").alias("body"), F.col("modificationTime").alias("at"))
    return small.unionByName(large)


def fetch(spark: SparkSession, path: str, now: str, since: str | None = None, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """A page of items and the next cursor: files changed since the last cursor. None changed: no items, the same cursor."""
    docs = read_files(spark, path, after=cursor)
    last = docs.agg(F.date_format(F.max("at"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    return normalise(entries(docs), now, since), last or cursor


#: Adapters by name; another name is an error, never an import.
READERS: dict[str, Callable[..., DataFrame]] = {"rss": lambda documents, now, since=None: normalise(entries(documents), now, since)}


def read(adapter: str, documents: DataFrame, now: str, since: str | None = None) -> DataFrame:
    if adapter not in READERS:
        raise ValueError(f"unknown adapter {adapter!r}; known: {', '.join(sorted(READERS))}")
    return READERS[adapter](documents, now, since)


def payload_ids(jobs: DataFrame, payload: str = "payload") -> DataFrame:
    """(job_id, item_id): the ids inside a JSON payload's items."""
    items = F.from_json(F.col(payload), "items array<struct<id:bigint>>")["items"]
    return jobs.select("job_id", F.explode(items).alias("i")).select("job_id", F.col("i.id").alias("item_id"))


def newest_polls(polls: DataFrame) -> DataFrame:
    w = Window.partitionBy("provider").orderBy(F.desc("at"))
    return polls.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

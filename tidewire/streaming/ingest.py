"""Streams: feeds to classified rows, idempotent items, windows, circuits and open stories by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.functions import bits, text
from tidewire.operators import dedup, queues, tables


def late_tolerant(items: DataFrame, key: str = "url_hash", at: str = "published_at", late: str = "6 hours") -> DataFrame:
    """Each key once, though windows overlap; keys are forgotten when the watermark has passed."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, at: str = "ts", size: str = "1 hour", late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    w = events.withWatermark(at, late) if events.isStreaming else events
    out = w.groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, at: str = "ts", size: str = "6 hours", step: str = "3 hours", late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    w = events.withWatermark(at, late) if events.isStreaming else events
    out = w.groupBy(F.window(at, size, step), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(at, late) if events.isStreaming else events
    out = w.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


#: Seconds between runs of each recurring job.
TICKS = {"poll": 300, "embed": 60, "entities": 60, "cluster": 120, "claims": 180, "contradictions": 180, "reap": 90, "rejoin": 600}


def start(rows: DataFrame, job: str, batch, checkpoint: str, once: bool = False):
    """Run a foreachBatch function at its job's tick, or once over what is there. One query of a checkpoint runs at a time."""
    writer = rows.writeStream.queryName(job).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{TICKS[job]} seconds")).start()


def store_batch(snapshots: tables.Snapshots, sightings: tables.Snapshots | None = None, totals: tables.Snapshots | None = None):
    """foreachBatch: classify a batch against what is stored and append its new rows.

    A URL that is stored already is not stored again; with `sightings`, each time it was seen
    leaves a row (url_hash, published_at, batch_id). With `totals`, a row for each feed says how
    many items were fetched, stored, duplicates and skipped. A version carries its batch's
    number, so a batch that is run twice after a failure changes nothing.
    """

    def append(to: tables.Snapshots, rows: DataFrame, batch_id: int) -> None:
        if to.tag() != str(batch_id):
            to.write(rows, str(batch_id), append=True)

    def run(batch: DataFrame, batch_id: int) -> None:
        if snapshots.tag() == str(batch_id):
            return
        items = batch.where("skip_reason IS NULL").select("feed", "canonical_url", "title", "body_text", "published_at")
        items = items.withColumn("url_hash", text.url_hash(F.col("canonical_url"))).withColumn("content_hash", text.content_hash(F.col("body_text")))
        items = items.withColumn("simhash", bits.simhash(F.col("title"), F.col("body_text")))
        stored = snapshots.read()
        fresh = dedup.unseen(items, stored, "url_hash") if stored is not None else items.dropDuplicates(["url_hash"])
        begin = 0 if stored is None else stored.agg(F.max("id")).first()[0] or 0
        new = tables.numbered(fresh, [F.col("published_at"), F.col("url_hash")], "id", begin)
        status = dedup.classify(new) if stored is None else dedup.classify_new(new, stored)
        out = new.join(status, "id").drop("feed")
        if sightings is not None:
            append(sightings, items.select("url_hash", "published_at", F.lit(batch_id).alias("batch_id")), batch_id)
        if totals is not None:
            kept = new.groupBy("feed").agg(F.count("*").alias("stored"))
            all_ = batch.groupBy("feed").agg(F.count_if(F.col("skip_reason").isNull()).alias("fetched"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"))
            n = F.coalesce("stored", F.lit(0))
            append(totals, all_.join(kept, "feed", "left").select("feed", "fetched", n.alias("stored"), (F.col("fetched") - n).alias("duplicates"), "skipped", F.lit(batch_id).alias("batch_id")), batch_id)
        snapshots.write(out, str(batch_id), append=True)

    return run


CIRCUIT_OUT = "provider string, consecutive_failures int, circuit_state string"


def _circuit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fails = state.get[0] if state.exists else 0
    for pdf in batches:
        for ok in pdf.sort_values("at")["ok"]:
            fails = 0 if ok else fails + 1
    state.update((fails,))
    yield pd.DataFrame({"provider": [key[0]], "consecutive_failures": [fails], "circuit_state": ["open" if fails >= queues.OPEN_AFTER else "closed"]})


def circuits(polls: DataFrame) -> DataFrame:
    """The circuit of each provider after each micro-batch of polls(provider, at, ok): one number of state."""
    return polls.groupBy("provider").applyInPandasWithState(_circuit, CIRCUIT_OUT, "fails int", "update", GroupStateTimeout.NoTimeout)


STORY_OUT = "story_id bigint, articles bigint, last_activity timestamp, open boolean"


def _story(hours: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({"story_id": [key[0]], "articles": [n], "last_activity": [pd.Timestamp(last, unit="us")], "open": [False]})
            return
        n, last = state.get if state.exists else (0, 0)
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf["at"].max().value // 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"story_id": [key[0]], "articles": [n], "last_activity": [pd.Timestamp(last, unit="us")], "open": [True]})

    return run


def open_stories(joins: DataFrame, hours: int = 48, late: str = "6 hours") -> DataFrame:
    """Stories of joins(story_id, at): open while articles come, closed `hours` of event time after the last."""
    return joins.withWatermark("at", late).groupBy("story_id").applyInPandasWithState(_story(hours), STORY_OUT, "n bigint, last bigint", "update", GroupStateTimeout.EventTimeTimeout)


TIMER_OUT = "key string, last timestamp, expired boolean"


def _timer(seconds: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
        else:
            last = max([last, *(int(pdf["at"].max().value // 1000) for pdf in batches)])
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
            return
        yield pd.DataFrame({"key": [key[0]], "last": [pd.Timestamp(last, unit="us")], "expired": [True]})

    return run


def expiries(beats: DataFrame, seconds: int, late: str = "10 seconds") -> DataFrame:
    """A row for each key of beats(key, at) that was silent for so many seconds of event time.

    Leases (queues.LEASE_S), heartbeats (queues.HEARTBEAT_S) and open circuits
    (60 * queues.OPEN_MINUTES) end this way.
    """
    return beats.withWatermark("at", late).groupBy("key").applyInPandasWithState(_timer(seconds), TIMER_OUT, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)

"""Work queues as tables: dispatch, leases, retries, polls, circuit breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import moments

# Seconds of a lease and a heartbeat, failures that open a circuit, minutes it stays open.
LEASE_S, HEARTBEAT_S, OPEN_AFTER, OPEN_MINUTES = 900, 90, 5, 15


def dispatch(backlog: DataFrame, outstanding: DataFrame, order: list[str], limit: int, size: int, item: Column | None = None, usable: Column | None = None) -> DataFrame:
    """Jobs (batch, n, ids, payload): the first `limit` rows of the backlog, less those at work, in chunks of `size` in the backlog's order.

    The limit comes first, as one tick takes it, so rows that can't be processed at its
    head do hold the rest up. Rows of a chunk that can't be used (without text, unless
    `usable` says otherwise) stay out of its payload; a chunk without any is no job.
    payload: JSON with a list `items` of what `item` makes of each row (its id and text).
    """
    head = backlog.orderBy(*order).limit(limit)
    todo = head.join(outstanding.select("id"), "id", "left_anti")
    at = F.row_number().over(Window.orderBy(*order)) - 1  # at most `limit` rows
    usable = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0 if usable is None else usable
    item = F.struct(F.col("id").cast("string").alias("id"), F.col("text")) if item is None else item
    rows = todo.withColumn("_at", at).where(usable).select(F.floor(F.col("_at") / size).cast("bigint").alias("batch"), F.struct("_at", "id", item.alias("item")).alias("r"))
    jobs = rows.groupBy("batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("r")).alias("rows"))
    items = F.transform("rows", lambda r: r["item"])
    return jobs.select("batch", "n", F.transform("rows", lambda r: r["id"]).alias("ids"), F.to_json(F.struct(items.alias("items"))).alias("payload"))


def with_members(stories: DataFrame, members: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """stories with the list `out` of their members' values in order; stories without members keep an empty one."""
    rows = members.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))).alias("_m"))
    got = stories.join(rows, key, "left").withColumn(out, F.transform("_m", lambda m: m["_v"])).drop("_m")
    return got.withColumn(out, F.coalesce(out, F.array().cast(got.schema[out].dataType)))


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("status") == "queued") & (F.col("available_at") <= now))


def lease(jobs: DataFrame, worker: str, now: Column, n: int) -> DataFrame:
    """jobs with the n first queued ones leased: by priority, then time, then id."""
    first = claimable(jobs, now).orderBy(F.desc("priority"), "available_at", "job_id").limit(n).select("job_id", F.lit(True).alias("_take"))
    took = F.coalesce("_take", F.lit(False))
    out = jobs.join(F.broadcast(first), "job_id", "left")  # n rows
    return out.select(
        *[c for c in jobs.columns if c not in ("status", "worker", "lease_expires_at", "attempts")],
        F.when(took, "leased").otherwise(F.col("status")).alias("status"),
        F.when(took, worker).otherwise(F.col("worker")).alias("worker"),
        F.when(took, F.timestamp_add("SECOND", F.lit(LEASE_S), now)).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"),
        (F.col("attempts") + took.cast("int")).alias("attempts"),
    )


def _retry(jobs: DataFrame, hit: Column, again: Column, now: Column) -> DataFrame:
    """Of the rows hit, those that may try again are queued after a backoff; the others failed."""
    later = F.timestamp_add("SECOND", moments.backoff_seconds(F.col("attempts")), now)
    out = jobs.withColumn("available_at", F.when(hit & again, later).otherwise(F.col("available_at")))
    return out.withColumn("status", F.when(hit & again, "queued").when(hit, "failed").otherwise(F.col("status")))


def fail(jobs: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """jobs after failures (job_id, retryable) of leased ones."""
    out = jobs.join(failed.select("job_id", F.col("retryable").alias("_again")), "job_id", "left")
    hit = F.col("_again").isNotNull() & (F.col("status") == "leased")
    return _retry(out, hit, F.col("_again") & (F.col("attempts") < F.col("max_attempts")), now).drop("_again")


def complete(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """jobs after completions (job_id); one that is done already stays so."""
    out = jobs.join(done.select("job_id", F.lit(True).alias("_hit")), "job_id", "left")
    return out.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "leased"), "done").otherwise(F.col("status"))).drop("_hit")


def extend(jobs: DataFrame, beats: DataFrame, now: Column) -> DataFrame:
    """jobs after heartbeats (job_id, worker): the holder's lease runs anew."""
    out = jobs.join(beats.select("job_id", F.col("worker").alias("_by")), "job_id", "left")
    own = (F.col("status") == "leased") & (F.col("worker") == F.col("_by"))
    return out.withColumn("lease_expires_at", F.when(own, F.timestamp_add("SECOND", F.lit(LEASE_S), now)).otherwise(F.col("lease_expires_at"))).drop("_by")


def reap(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs whose lease ran out go back to the queue, or failed when their attempts are used up."""
    gone = (F.col("status") == "leased") & (F.col("lease_expires_at") < now)
    return _retry(jobs, gone, F.col("attempts") < F.col("max_attempts"), now)


def worker_status(workers: DataFrame, now: Column) -> DataFrame:
    """A worker without a heartbeat for 90 s is offline."""
    stale = F.col("last_heartbeat_at").isNull() | (moments.age_seconds(F.col("last_heartbeat_at"), now) > HEARTBEAT_S)
    return workers.withColumn("status", F.when(stale, "offline").otherwise(F.col("status")))


def circuit(polls: DataFrame, now: Column | None = None, tie: str | None = None) -> DataFrame:
    """State of each provider's circuit after its polls(provider, at, ok): failures since the last success.

    OPEN_AFTER of them open it, with the last; after OPEN_MINUTES it is half-open (at `now`,
    if given): one poll may test it, and that poll's success closes it. Polls of one time
    are in order of the column `tie`. Aggregations combine map-side, so a provider may have any
    number of polls.
    """
    rows = polls.select("provider", "ok", F.struct("at", *([tie] if tie else [])).alias("s"))
    good = rows.where("ok").groupBy("provider").agg(F.max("s").alias("last"))
    bad = rows.where("NOT ok").join(good, "provider", "left").where("last IS NULL OR s > last")
    runs = bad.groupBy("provider").agg(F.count("*").alias("fails"), F.max("s").alias("end"))
    fails = F.coalesce("fails", F.lit(0))
    opened = F.when(fails >= OPEN_AFTER, F.col("end.at"))
    state = F.when(fails < OPEN_AFTER, "closed")
    if now is not None:
        state = state.when(moments.age_seconds(opened, now) >= OPEN_MINUTES * 60, "half_open")
    out = polls.select("provider").distinct().join(runs, "provider", "left")
    return out.select("provider", fails.alias("consecutive_failures"), state.otherwise("open").alias("circuit_state"), opened.alias("circuit_opened_at"))


def circuit_allows(state: Column, opened_at: Column, now: Column) -> Column:
    """Closed, or open for its minutes: then one poll may test it."""
    return (state != "open") | (moments.age_seconds(opened_at, now) >= OPEN_MINUTES * 60)

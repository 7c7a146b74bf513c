"""Work queues, polls, heartbeats and times over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import moments
from tidewire.operators import queues as ops
from tidewire.sources import feeds

from . import domain as d
from .registry import Tables, query

NOW = f"TIMESTAMP '{d.NOW}'"


def _polls(t: Tables):
    return t.events.select(F.col("user_id").alias("provider"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"), "event_id")


def _providers(t: Tables):
    return _polls(t).groupBy("provider").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_error"))


PROVIDERS = "(SELECT user_id AS provider, max(ts) FILTER (WHERE event_type <> 'error') AS last_success, max(ts) FILTER (WHERE event_type = 'error') AS last_error FROM events GROUP BY 1)"


@query(f"SELECT provider FROM {PROVIDERS} WHERE greatest(last_success, last_error) IS NULL OR greatest(last_success, last_error) + to_minutes(2880 + provider * 30) <= {NOW}")
def due_providers(t: Tables):
    minutes = (F.lit(2880) + F.col("provider") * 30).cast("int")
    return _providers(t).where(moments.is_due(F.col("last_success"), F.col("last_error"), minutes, d.now())).select("provider")


@query(f"SELECT provider, coalesce(last_success - INTERVAL 6 HOUR, {NOW} - INTERVAL 7 DAY) AS since FROM {PROVIDERS}")
def poll_window(t: Tables):
    return _providers(t).select("provider", moments.window_start(F.col("last_success"), d.now()).alias("since"))


@query("SELECT event_id, CAST(least(60 * pow(2, greatest(user_id % 9 - 1, 0)), 3600) AS BIGINT) AS backoff_s FROM events")
def backoff_schedule(t: Tables):
    return t.events.select("event_id", moments.backoff_seconds(F.col("user_id") % 9).alias("backoff_s"))


@query(f"SELECT user_id AS worker_id, CASE WHEN epoch_us({NOW}) - epoch_us(max(ts)) >= 86401000000 + (user_id % 2) * 86400000000 THEN 'offline' ELSE 'online' END AS status FROM events GROUP BY user_id")
def stale_workers(t: Tables):
    """Heartbeats here are days apart, so the clock is moved by one or two days."""
    w = t.events.groupBy(F.col("user_id").alias("worker_id")).agg(F.max("ts").alias("seen"))
    shift = F.timestamp_add("SECOND", ((1 + F.col("worker_id") % 2) * 86400 - ops.HEARTBEAT_S).cast("int"), F.col("seen"))
    return ops.worker_status(w.select("worker_id", shift.alias("last_heartbeat_at"), F.lit("online").alias("status")), d.now()).select("worker_id", "status")


@query(f"SELECT event_type AS job_type, count(*) AS depth, CAST(floor((epoch_us({NOW}) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS oldest_s FROM events WHERE value < 50 GROUP BY 1")
def queue_age(t: Tables):
    return t.events.where("value < 50").groupBy(F.col("event_type").alias("job_type")).agg(F.count("*").alias("depth"), F.min("ts").alias("t")).select("job_type", "depth", moments.age_seconds(F.col("t"), d.now()).alias("oldest_s"))


@query("""SELECT batch, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n_chars, doc_id) AS ids FROM (SELECT *, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32 AS batch FROM
(SELECT * FROM documents ORDER BY n_chars, doc_id LIMIT 200) WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE length(trim(coalesce(text, ''))) > 0 GROUP BY 1""")
def dispatch_batches(t: Tables):
    """One tick of 200 rows in batches of 32; labelled documents are at work already."""
    backlog = t.documents.select(F.col("doc_id").alias("id"), "text", "n_chars")
    out = ops.dispatch(backlog, t.labels.select(F.col("doc_id").alias("id")), ["n_chars", "id"], 200, 32)
    return out.select("batch", "n", F.array_join("ids", ",").alias("ids"))


def _jobs(t: Tables):
    status = F.when(F.col("event_type") == "error", "leased").when(F.col("event_type") == "signup", "done").otherwise("queued")
    return t.events.select(
        F.col("event_id").alias("job_id"), status.alias("status"), (F.col("user_id") % 3).alias("priority"), F.col("ts").alias("available_at"), F.lit(None).cast("string").alias("worker"),
        F.timestamp_add("SECOND", F.lit(ops.LEASE_S), F.col("ts")).alias("lease_expires_at"), (F.col("user_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
    )


JOBS = "(SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'leased' WHEN 'signup' THEN 'done' ELSE 'queued' END AS status, user_id % 3 AS priority, ts AS available_at, ts + INTERVAL 900 SECOND AS lease_expires_at, CAST(user_id % 4 AS INTEGER) AS attempts FROM events)"


@query(f"SELECT job_id, CASE WHEN rn <= 10 THEN 'leased' ELSE status END AS status, CAST(attempts + CASE WHEN rn <= 10 THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM (SELECT *, CASE WHEN status = 'queued' AND available_at <= {NOW} THEN row_number() OVER (PARTITION BY status = 'queued' AND available_at <= {NOW} ORDER BY priority DESC, available_at, job_id) END AS rn FROM {JOBS})")
def lease_claim(t: Tables):
    return ops.lease(_jobs(t), "w1", d.now(), 10).select("job_id", "status", "attempts")


@query(f"SELECT job_id, CASE WHEN status = 'leased' AND lease_expires_at < TIMESTAMP '2024-01-20' AND attempts >= 3 THEN 'failed' WHEN status = 'leased' AND lease_expires_at < TIMESTAMP '2024-01-20' THEN 'queued' ELSE status END AS status FROM {JOBS}")
def lease_reap(t: Tables):
    return ops.reap(_jobs(t), F.lit("2024-01-20").cast("timestamp")).select("job_id", "status")


@query(f"""SELECT job_id, CASE WHEN status = 'leased' AND job_id % 2 = 0 AND attempts >= 3 THEN 'failed' WHEN status = 'leased' AND job_id % 2 = 0 THEN 'queued' ELSE status END AS status,
CASE WHEN status = 'leased' AND job_id % 2 = 0 AND attempts < 3 THEN {NOW} + to_seconds(CAST(least(60 * pow(2, greatest(attempts - 1, 0)), 3600) AS BIGINT)) ELSE available_at END AS available_at FROM {JOBS}""")
def lease_fail(t: Tables):
    return ops.fail(_jobs(t), _jobs(t).where("job_id % 2 = 0").select("job_id", F.lit(True).alias("retryable")), d.now()).select("job_id", "status", "available_at")


@query("""SELECT provider, CAST(fails AS BIGINT) AS consecutive_failures, CASE WHEN fails >= 5 THEN 'open' ELSE 'closed' END AS circuit_state FROM
(SELECT user_id AS provider, count(*) FILTER (WHERE event_type = 'error' AND ts > coalesce(last_ok, TIMESTAMP '1970-01-01')) AS fails
FROM (SELECT *, max(ts) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id) AS last_ok FROM events) GROUP BY 1)""")
def circuit_states(t: Tables):
    return ops.circuit(_polls(t)).select("provider", "consecutive_failures", "circuit_state")


@query("""SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') || '+00:00' AS iso FROM events""")
def iso_timestamp(t: Tables):
    return t.events.select("event_id", moments.iso(F.col("ts")).alias("iso"))


AGE = f"CAST(floor((epoch_us({NOW}) - epoch_us(ts)) / 1000000) AS BIGINT)"


@query(f"""SELECT event_id, CASE WHEN {AGE} < 60 THEN 'just now' WHEN {AGE} < 3600 THEN ({AGE} // 60) || 'm ago' WHEN {AGE} < 86400 THEN ({AGE} // 3600) || 'h ago' WHEN {AGE} < 604800 THEN ({AGE} // 86400) || 'd ago' ELSE strftime(ts, '%b %-d, %Y') END AS shown FROM events""")
def relative_time(t: Tables):
    return t.events.select("event_id", moments.relative(F.col("ts"), d.now()).alias("shown"))


@query("SELECT doc_id, CAST(greatest(1, floor(n_chars / 20 / 60 + 0.5)) AS INTEGER) AS minutes FROM documents")
def reading_time(t: Tables):
    return t.documents.select("doc_id", moments.reading_minutes(F.col("n_chars") / 20).alias("minutes"))


@query("""SELECT event_id, len([x FOR x IN [1, 2, 3] IF x <= k % 4]) > 0 AS flagged FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def json_patterns_flagged(t: Tables):
    """Flags documents {"patterns": [...]} with as many names as k mod 4; a missing list counts as empty."""
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.filter(F.array(F.lit("a"), F.lit("b"), F.lit("c")), lambda x, i: i < k % 4)
    flags = F.when(k % 4 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(names.alias("patterns"))))
    out = t.events.select("event_id", flags.alias("flags"))
    return out.select("event_id", (F.coalesce(F.json_array_length(F.get_json_object("flags", "$.patterns")), F.lit(0)) > 0).alias("flagged"))


@query("SELECT o_orderkey AS job_id, l_partkey AS item_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def json_unnest_ids(t: Tables):
    """Ids inside JSON payloads that are built from the members of each order."""
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("id"))).alias("items"))
    jobs = lists.join(t.orders.select(F.col("o_orderkey").alias("job_id")), "job_id", "left_semi").select("job_id", F.to_json(F.struct("items")).alias("payload"))
    return feeds.payload_ids(jobs)


@query("SELECT user_id AS provider, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def newest_poll(t: Tables):
    w = Window.partitionBy("provider").orderBy(F.desc("at"), F.desc("event_id"))
    return _polls(t).withColumn("r", F.row_number().over(w)).where("r = 1").select("provider", "event_id")

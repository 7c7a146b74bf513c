"""Counts, funnels, activity and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import domain as d
from .registry import Tables, query


@query("""SELECT count(*) AS ingested, count(*) FILTER (WHERE n_chars > 200) AS embedded, count(*) FILTER (WHERE n_chars > 200 AND lang = 'en') AS extracted,
count(*) FILTER (WHERE n_chars > 2000 AND lang = 'en') AS clustered FROM documents""")
def funnel_counts(t: Tables):
    n, en = F.col("n_chars"), F.col("lang") == "en"
    return t.documents.agg(F.count("*").alias("ingested"), F.count_if(n > 200).alias("embedded"), F.count_if((n > 200) & en).alias("extracted"), F.count_if((n > 2000) & en).alias("clustered"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90) AS flagged,
count(*) FILTER (WHERE ts >= TIMESTAMP '{d.NOW}' - INTERVAL 48 HOUR) AS last_48h, count(*) FILTER (WHERE ts >= TIMESTAMP '{d.NOW}' - INTERVAL 25 HOUR) AS last_25h,
count(*) FILTER (WHERE event_type = 'error') AS awaiting FROM events""")
def ingest_header(t: Tables):
    e = t.events
    since = lambda h: F.count_if(F.col("ts") >= d.now() - F.expr(f"INTERVAL {h} HOURS"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.agg(F.count("*").alias("total"), F.count_if(k > 90).alias("flagged"), since(48).alias("last_48h"), since(25).alias("last_25h"), F.count_if(F.col("event_type") == "error").alias("awaiting"))


@query(f"SELECT status, count(*) AS n FROM {d.ARTICLES} GROUP BY status")
def articles_by_status(t: Tables):
    return d.articles(t).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT event_type AS job_type, CASE WHEN value > 200 THEN 'failed' WHEN value > 100 THEN 'leased' ELSE 'queued' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def jobs_by_type_and_status(t: Tables):
    status = F.when(F.col("value") > 200, "failed").when(F.col("value") > 100, "leased").otherwise("queued")
    return t.events.select(F.col("event_type").alias("job_type"), status.alias("status")).groupBy("job_type", "status").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS scored, CAST(floor(avg(o_totalprice) + 0.5) AS BIGINT) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders WHERE o_orderstatus <> 'P'""")
def score_summary(t: Tables):
    return t.orders.where("o_orderstatus <> 'P'").agg(F.count("*").alias("scored"), F.floor(F.avg("o_totalprice") + 0.5).cast("bigint").alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("""SELECT count(*) AS stories, CAST(sum(n) AS BIGINT) AS articles, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS singletons FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def cluster_shape(t: Tables):
    per = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("stories"), F.sum("n").alias("articles"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))


@query(f"SELECT name, entity_id, count(*) AS mentions FROM lineitem JOIN {d.ENTITIES} e ON e.entity_id = l_partkey GROUP BY name, entity_id ORDER BY mentions DESC, name, entity_id LIMIT 10")
def top_entities(t: Tables):
    n = d.edges(t).groupBy("entity_id").agg(F.count("*").alias("mentions"))
    return n.join(d.entities(t), "entity_id").select("name", "entity_id", "mentions").orderBy(F.desc("mentions"), "name", "entity_id").limit(10)


@query("""SELECT l_orderkey AS story_id, l_partkey AS article_id, l_linenumber AS line, count(*) OVER (PARTITION BY l_orderkey) AS members FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 3)""")
def cluster_listing(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("story_id"), F.col("l_partkey").alias("article_id"), F.col("l_linenumber").alias("line"))
    # One window serves the count and the filter on it: no semi-join.
    return rows.withColumn("members", F.count("*").over(Window.partitionBy("story_id"))).where("members > 3")


@query("""SELECT s_suppkey AS source_id, s_name AS domain, count(l_orderkey) AS n, max(l_shipdate) AS last_seen FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 49 GROUP BY 1, 2""")
def source_activity(t: Tables):
    seen = t.lineitem.where("l_quantity > 49").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last_seen"))
    s = t.supplier.join(seen, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("domain"), F.coalesce("n", F.lit(0)).alias("n"), "last_seen")


@query("""SELECT n_name AS provider, count(l_orderkey) AS articles, count(DISTINCT s_suppkey) AS sources FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def provider_activity(t: Tables):
    per = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = t.supplier.join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_nationkey").agg(F.sum(F.coalesce("n", F.lit(0))).alias("articles"), F.count("*").alias("sources"))
    out = t.nation.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return out.select(F.col("n_name").alias("provider"), F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("sources", F.lit(0)).alias("sources"))


@query("""SELECT l_orderkey AS article_id, l_linenumber AS line, l_partkey AS part, s_name AS source, n_name AS provider FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_returnflag = 'N'""")
def recent_with_source(t: Tables):
    rows = t.lineitem.where("l_returnflag = 'N'").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("s_name").alias("source"), F.col("n_name").alias("provider"))


@query("SELECT user_id AS provider, count(*) AS fetched, count(*) FILTER (WHERE value > 50) AS stored, count(*) FILTER (WHERE value <= 50) AS duplicates FROM events GROUP BY 1")
def poll_totals(t: Tables):
    return t.events.groupBy(F.col("user_id").alias("provider")).agg(F.count("*").alias("fetched"), F.count_if(F.col("value") > 50).alias("stored"), F.count_if(F.col("value") <= 50).alias("duplicates"))


@query("SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY 1, 2) WHERE r = 1")
def most_common_source(t: Tables):
    per = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "first")
    return per.withColumn("r", F.row_number().over(w)).where("r = 1").select("lang", "source", "n")


@query("SELECT DISTINCT id FROM (SELECT l_suppkey AS id FROM lineitem UNION ALL SELECT s_suppkey FROM supplier)")
def id_union(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("id")).union(t.supplier.select("s_suppkey")).distinct()


@query("""SELECT story_id, coalesce(string_agg(CASE WHEN a AND NOT b THEN '-' || e WHEN b AND NOT a THEN '+' || e END, ',' ORDER BY e), '') AS diff FROM
(SELECT l_orderkey AS story_id, l_partkey AS e, bool_or(l_linenumber <= 4) AS a, bool_or(l_linenumber > 4) AS b FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def entity_set_diff(t: Tables):
    """Entities of a story before (lines up to 4) and after: removed and added ones."""
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("story_id"), F.col("l_partkey").alias("e")).agg(F.bool_or(F.col("l_linenumber") <= 4).alias("a"), F.bool_or(F.col("l_linenumber") > 4).alias("b"))
    mark = F.when(F.col("a") & ~F.col("b"), F.concat(F.lit("-"), "e")).when(F.col("b") & ~F.col("a"), F.concat(F.lit("+"), "e"))
    kept = rows.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("e", mark.alias("m")))).alias("s"))
    return kept.select("story_id", F.array_join(F.transform("s", lambda x: x["m"]), ",").alias("diff"))


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round_even(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def events_tumbling_day(t: Tables):
    out = t.events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.bround("total", 2).alias("total"))


@query("""SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS w FROM events) GROUP BY 1, 2""")
def events_sliding(t: Tables):
    from tidewire.streaming.ingest import sliding

    return sliding(t.events).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM
(SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s""")
def events_sessions(t: Tables):
    from tidewire.streaming.ingest import sessions

    out = sessions(t.events, gap="6 hours")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


@query("""SELECT user_id, day, n, CAST(n - lag(n) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS velocity FROM (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)""")
def signal_velocity(t: Tables):
    per = t.events.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    return per.withColumn("velocity", F.col("n") - F.lag("n").over(Window.partitionBy("user_id").orderBy("day")))


@query("""SELECT quality AS verdict, count(*) AS n FROM labels GROUP BY 1""")
def label_verdicts(t: Tables):
    return t.labels.groupBy(F.col("quality").alias("verdict")).agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) FILTER (WHERE quality = 1) AS correct, count(*) FILTER (WHERE quality = 0) AS wrong,
round_even(count(*) FILTER (WHERE quality = 1) / nullif(count(*), 0), 4) AS precision FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def label_precision(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    good = F.count_if(F.col("quality") == 1)
    return rows.groupBy("lang").agg(good.alias("correct"), F.count_if(F.col("quality") == 0).alias("wrong"), F.bround(F.try_divide(good, F.count("*")), 4).alias("precision"))


@query("""SELECT user_id, count(*) AS attempts, max(c) AS most_in_window FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 900 SECOND PRECEDING AND CURRENT ROW) AS c FROM events WHERE event_type = 'signup') GROUP BY 1""")
def attempt_windows(t: Tables):
    rows = t.events.where("event_type = 'signup'")
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-900_000_000, 0)
    return rows.withColumn("c", F.count("*").over(w)).groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("c").alias("most_in_window"))


@query("""SELECT 'pair_order' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey >= l_partkey UNION ALL
SELECT 'unique_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
SELECT 'confidence_range', count(*) FROM lineitem WHERE NOT (l_quantity BETWEEN 0 AND 100) UNION ALL
SELECT 'has_source', count(*) FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey IS NULL""")
def constraint_violations(t: Tables):
    """One pass over lines by key; the two rules of single lines are counted in it."""
    known = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("known"))
    per = t.lineitem.join(known, "l_suppkey", "left").groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_orderkey") >= F.col("l_partkey")).alias("order"), F.count_if(~F.col("l_quantity").between(0, 100)).alias("range"), F.count_if(F.col("known").isNull()).alias("lost")
    )
    sums = per.agg(*(F.sum(c).alias(c) for c in ("order", "range", "lost")), F.count_if(F.col("n") > 1).alias("twice"))
    rules = F.array(*(F.struct(F.lit(rule).alias("rule"), F.coalesce(c, F.lit(0)).alias("violations")) for rule, c in (("pair_order", "order"), ("unique_line", "twice"), ("confidence_range", "range"), ("has_source", "lost"))))
    return sums.select(F.inline(rules))

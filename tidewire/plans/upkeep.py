"""Markers, labels, ids, roles and quotas over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import serving, upkeep

from . import domain as d
from .registry import Tables, query

NOW = f"TIMESTAMP '{d.NOW}'"


@query("SELECT doc_id FROM documents WHERE n_chars > 100 AND lang <> 'es' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def ready_articles(t: Tables):
    in_story = t.labels.select("doc_id", F.col("doc_id").alias("story_id"))
    docs = t.documents.join(in_story, "doc_id", "left")
    docs = docs.withColumn("embedding", F.when(F.col("n_chars") > 100, F.col("text"))).withColumn("entities_extracted_at", F.when(F.col("lang") != "es", F.lit(1)))
    return upkeep.ready(docs).select("doc_id")


@query(f"SELECT count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 48 HOUR) AS recent, count(*) FILTER (WHERE ts <= {NOW} - INTERVAL 48 HOUR) AS stale FROM events")
def recent_and_stale(t: Tables):
    return t.events.agg(F.count_if(upkeep.is_recent("ts", d.now())).alias("recent"), F.count_if(upkeep.is_stale("ts", d.now())).alias("stale"))


@query("SELECT l_orderkey AS story_id FROM lineitem GROUP BY 1 HAVING count(*) = 1")
def singleton_stories(t: Tables):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("story_id")).count().where("count = 1").select("story_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) ORDER BY label NULLS FIRST, vec_id LIMIT 50")
def unlabelled_placements(t: Tables):
    left = t.embeddings.select("vec_id", "label").join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")
    return serving.latest(left, [F.asc_nulls_first("label"), F.asc("vec_id")], 50)


@query("SELECT page_id, doc_id AS article_id, doc_id IS NULL AS unknown FROM pages LEFT JOIN documents ON doc_id = page_id * 7")
def resolve_ids(t: Tables):
    refs = t.pages.select("page_id", (F.col("page_id") * 7).alias("ref"))
    known = t.documents.select(F.col("doc_id").alias("ref"), F.col("doc_id").alias("article_id"))
    return upkeep.resolve(refs, known, "ref", "article_id").select("page_id", "article_id", "unknown")


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 10 = 0 AND quality = 1 THEN 0 ELSE quality END AS INTEGER) AS quality FROM labels")
def label_corrections(t: Tables):
    fixes = t.labels.where("doc_id % 10 = 0").select("doc_id", F.lit(1).alias("expected"), F.lit(0).alias("value")).distinct()
    return upkeep.guarded_update(t.labels.select("doc_id", "quality"), fixes, "doc_id", "quality")


@query("SELECT doc_id FROM labels WHERE doc_id % 10 = 0 AND quality = 1")
def label_audit(t: Tables):
    before = t.labels.select("doc_id", "quality")
    fixes = t.labels.where("doc_id % 10 = 0").select("doc_id", F.lit(1).alias("expected"), F.lit(0).alias("value")).distinct()
    after = upkeep.guarded_update(before, fixes, "doc_id", "quality")
    return upkeep.audit(before, after, "doc_id", ["quality"], "reviewer", d.now()).select("doc_id")


@query("SELECT c_custkey AS user_id, (c_nationkey % 5 = 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY')) AS allowed FROM customer")
def role_check(t: Tables):
    roles = F.array(F.when(F.col("c_nationkey") % 5 == 0, "admin").otherwise("reader"), F.lower("c_mktsegment"))
    return t.customer.select(F.col("c_custkey").alias("user_id"), upkeep.may(roles, "building", "machinery").alias("allowed"))


@query(f"SELECT event_id, (user_id % 3 = 0 OR (user_id % 3 = 1 AND ts + INTERVAL 10 DAY > {NOW})) AS valid FROM events")
def token_validity(t: Tables):
    k = F.col("user_id") % 3
    ok = upkeep.token_valid(k, F.lit(0), F.lit(1), F.col("ts") + F.expr("INTERVAL 10 DAYS"), d.now())
    return t.events.select("event_id", ok.alias("valid"))


@query(f"SELECT user_id AS provider, CASE WHEN max(CAST(ts AS DATE)) < CAST({NOW} AS DATE) - 1 THEN 0 ELSE count(*) END AS quota_used FROM events GROUP BY 1")
def quota_reset(t: Tables):
    """Providers polled on the last day of January keep their count; the clock is moved back a day."""
    p = t.events.groupBy(F.col("user_id").alias("provider")).agg(F.count("*").alias("quota_used"), F.max(F.to_date("ts")).alias("quota_day"))
    return upkeep.reset_quota(p, d.now() - F.expr("INTERVAL 1 DAY")).select("provider", "quota_used")


@query(f"SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS enabled, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS open_circuits, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS published_since FROM orders")
def admin_tallies(t: Tables):
    return t.orders.agg(F.count_if(F.col("o_orderstatus") != "P").alias("enabled"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("open_circuits"), F.count_if(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp")).alias("published_since"))


@query("SELECT o_orderkey AS id, (CAST(o_orderdate AS DATE) = make_date(1998, month(o_orderdate), 10)) AS path_matches FROM orders")
def date_path_check(t: Tables):
    made = F.make_date(F.lit(1998), F.month("o_orderdate"), F.lit(10))
    return t.orders.select(F.col("o_orderkey").alias("id"), (F.to_date("o_orderdate") == made).alias("path_matches"))


@query("SELECT l_orderkey AS story_id, min(l_linenumber) = 1 AS has_founder, list_contains(list(l_partkey), l_orderkey) AS own, len(list_distinct(list(l_suppkey))) AS sources FROM lineitem GROUP BY l_orderkey")
def story_sets(t: Tables):
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("story_id")).agg(F.min("l_linenumber").alias("first"), F.collect_set("l_partkey").alias("parts"), F.collect_set("l_suppkey").alias("s"))
    return per.select("story_id", (F.col("first") == 1).alias("has_founder"), F.array_contains("parts", F.col("story_id")).alias("own"), F.size("s").cast("bigint").alias("sources"))

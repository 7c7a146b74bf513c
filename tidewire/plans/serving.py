"""Public and admin reads over articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import serving as ops

from . import domain as d
from .registry import Tables, query

def _newest():
    return [F.desc_nulls_last("published_at"), F.desc("id")]


SHOWN = "id, category, hero, published_at, price"


@query(f"SELECT {SHOWN} FROM {d.CATEGORISED} WHERE status = 'published' AND category = 'building' ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20")
def published_page(t: Tables):
    rows = ops.optional(ops.visible(d.categorised(t)), "category", "building")
    return ops.page(rows.select(*SHOWN.split(", ")), _newest(), ops.PageRequest(2, 20))


@query(f"""WITH p AS (SELECT * FROM {d.CATEGORISED} WHERE status = 'published' AND category = 'building' ORDER BY published_at DESC, id DESC LIMIT 21 OFFSET 20)
SELECT CAST(least(count(*), 20) AS BIGINT) AS items, count(*) > 20 AS has_more, CAST(20 + least(count(*), 20) + CASE WHEN count(*) > 20 THEN 1 ELSE 0 END AS BIGINT) AS total_estimate FROM p""")
def published_total_estimate(t: Tables):
    return ops.page_state(ops.optional(ops.visible(d.categorised(t)), "category", "building"), _newest(), ops.PageRequest(2, 20))


@query(f"SELECT id, status, published_at, (SELECT count(*) FROM orders) AS total FROM {d.ARTICLES} ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 25 OFFSET 50")
def admin_page_exact(t: Tables):
    rows = d.articles(t)
    total = rows.agg(F.count("*").alias("total"))
    return ops.page(rows.select("id", "status", "published_at"), _newest(), ops.PageRequest(3, 25)).join(F.broadcast(total))


@query(f"SELECT id, published_at FROM {d.ARTICLES} WHERE status = 'published' ORDER BY published_at DESC, id DESC LIMIT 100")
def latest_n(t: Tables):
    return ops.latest(ops.visible(d.articles(t)).select("id", "published_at"), _newest(), 100)


@query(f"SELECT category, rank, id FROM (SELECT category, id, CAST(row_number() OVER (PARTITION BY category ORDER BY published_at DESC, id DESC) AS INTEGER) AS rank FROM {d.CATEGORISED} WHERE status = 'published') WHERE rank <= 4")
def category_top4(t: Tables):
    return ops.top_per_key(ops.visible(d.categorised(t)), ["category"], _newest(), 4).select("category", "rank", "id")


@query(f"""SELECT id, position, CASE WHEN position = 1 THEN 'lead' WHEN position <= 5 THEN 'secondary' WHEN position <= 11 THEN 'latest' ELSE 'rest' END AS slot
FROM (SELECT id, CAST(row_number() OVER (ORDER BY published_at DESC, id DESC) AS INTEGER) AS position FROM {d.ARTICLES} WHERE status = 'published') WHERE position <= 30""")
def homepage_slots(t: Tables):
    return ops.homepage_slots(ops.visible(d.articles(t)), _newest()).select("id", "position", "slot")


@query("""SELECT o_orderkey AS id, coalesce(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS refs, count(l_orderkey) AS n_refs
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def article_children(t: Tables):
    kids = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", F.col("l_suppkey").cast("string").alias("ref"), "l_suppkey")
    out = ops.children(t.orders.select(F.col("o_orderkey").alias("id")), kids, "id", ["l_linenumber", "l_partkey", "l_suppkey"], "ref", "refs")
    return out.select("id", F.array_join("refs", ",").alias("refs"), F.size("refs").cast("bigint").alias("n_refs"))


@query(f"SELECT id, CASE WHEN published_at IS NULL THEN '/preview/' || id ELSE '/' || category || '/' || strftime(published_at, '%Y/%m/%d') || '/' || 'a-' || id END AS path FROM {d.CATEGORISED}")
def article_path(t: Tables):
    a = d.categorised(t)
    return a.select("id", text.article_path(F.col("category"), F.col("published_at"), F.concat(F.lit("a-"), F.col("id")), F.col("id").cast("string")).alias("path"))


@query("SELECT p_partkey AS id, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN ' ' WHEN p_size % 3 = 1 THEN p_brand END), ''), p_name) AS title FROM part")
def seo_fallback(t: Tables):
    given = F.when(F.col("p_size") % 3 == 0, " ").when(F.col("p_size") % 3 == 1, F.col("p_brand"))
    return t.part.select(F.col("p_partkey").alias("id"), text.seo_title(given, F.col("p_name")).alias("title"))


@query(f"""SELECT path, CAST(priority AS DOUBLE) AS priority FROM (SELECT '/' AS path, 1.0 AS priority UNION ALL SELECT '/about', 0.3 UNION ALL SELECT DISTINCT '/' || lower(c_mktsegment), 0.8 FROM customer
UNION ALL (SELECT '/' || category || '/a-' || id, 0.6 FROM {d.CATEGORISED} WHERE status = 'published' ORDER BY published_at DESC, id DESC LIMIT 500))""")
def sitemap(t: Tables):
    fixed = t.spark.range(2).select(F.when(F.col("id") == 0, "/").otherwise("/about").alias("path"), F.when(F.col("id") == 0, 1.0).otherwise(0.3).alias("priority"))
    cats = t.customer.select(F.concat(F.lit("/"), F.lower("c_mktsegment")).alias("path")).distinct().withColumn("priority", F.lit(0.8))
    new = ops.latest(ops.visible(d.categorised(t)), _newest(), 500).select(F.concat(F.lit("/"), "category", F.lit("/a-"), "id").alias("path"), F.lit(0.6).alias("priority"))
    return fixed.unionByName(cats).unionByName(new)


@query(f"SELECT id, to_json({{'id': id, 'status': status, 'category': category}}) AS body FROM {d.CATEGORISED}")
def article_json(t: Tables):
    return d.categorised(t).select("id", F.to_json(F.struct("id", "status", "category")).alias("body"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, (l_returnflag IN ('A', 'R') AND l_quantity <= 24) AS renderable FROM lineitem")
def price_renderable(t: Tables):
    source = F.when(F.col("l_returnflag") == "A", "api").when(F.col("l_returnflag") == "R", "admin_override").otherwise("scraped")
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), ops.renderable_price(source, F.col("l_quantity"), 24).alias("renderable"))

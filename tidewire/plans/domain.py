"""The domain's tables as views of the given ones, and the same views as SQL.

orders are articles and stories, lineitem their members, evidence and entity edges, part the
entities, supplier the sources, nation their countries, customer the categories, events jobs,
polls and heartbeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

#: Clock of all queries.
NOW = "2024-02-01 00:00:00"
#: Nations that stand for the home country, and for authorities.
HOME, AUTHORITIES = tuple(range(5)), (20, 21)
#: The part type that stands for untyped entities.
UNTYPED = "PROMO"


def articles(t: Tables) -> DataFrame:
    o = t.orders
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "draft").otherwise("review")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("custkey"), status.alias("status"), F.col("o_orderdate").alias("published_at"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


ARTICLES = "(SELECT o_orderkey AS id, o_custkey AS custkey, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'review' END AS status, o_orderdate AS published_at, o_totalprice AS price, o_orderpriority AS priority FROM orders)"


def categorised(t: Tables) -> DataFrame:
    """Articles with their category (inner) and their hero's name (left)."""
    cats = t.customer.select(F.col("c_custkey").alias("custkey"), F.lower("c_mktsegment").alias("category"))
    media = t.part.select(F.col("p_partkey").alias("hero_id"), F.col("p_name").alias("hero"))
    a = articles(t).withColumn("hero_id", F.col("id") * 7)
    return a.join(cats, "custkey").join(media, "hero_id", "left")


CATEGORISED = f"(SELECT a.*, a.id * 7 AS hero_id, lower(c.c_mktsegment) AS category, p.p_name AS hero FROM {ARTICLES} a JOIN customer c ON c.c_custkey = a.custkey LEFT JOIN part p ON p.p_partkey = a.id * 7)"


def edges(t: Tables) -> DataFrame:
    """Article to entity: article_id, entity_id, mention_count."""
    return t.lineitem.select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").cast("bigint").alias("mention_count"))


def entities(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_type") == UNTYPED, "OTHER").otherwise(F.col("p_type"))
    name = F.concat_ws(" ", "p_name", F.col("p_size"))
    return t.part.select(F.col("p_partkey").alias("entity_id"), name.alias("name"), kind.alias("entity_type"))


ENTITIES = f"(SELECT p_partkey AS entity_id, p_name || ' ' || p_size AS name, CASE WHEN p_type = '{UNTYPED}' THEN 'OTHER' ELSE p_type END AS entity_type FROM part)"


def members(t: Tables) -> DataFrame:
    """Member articles of stories with their source and its country."""
    s = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").cast("int").alias("nation"))
    country = F.when(F.col("nation").isin(*HOME), "US").otherwise("XX")
    return t.lineitem.select(F.col("l_orderkey").alias("story_id"), F.col("l_suppkey").alias("source_id")).join(s, "source_id").select("story_id", "source_id", country.alias("country"))


def documents(t: Tables) -> DataFrame:
    """Documents as captured items: id, title (first line), body."""
    return t.documents.select(F.col("doc_id").alias("id"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"), F.coalesce("text", F.lit("")).alias("body"), "source", "lang")


def now():
    return F.lit(NOW).cast("timestamp")

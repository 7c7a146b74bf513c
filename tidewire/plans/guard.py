"""Document frequency, aliases and guards over lineitem (edges) and part (entities)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import clustering, guard, work

from . import domain as d
from .registry import Tables, query

#: The ceiling on common entities here, and its floor.
FRACTION, FLOOR = 0.002, 5


def _over(t: Tables):
    return guard.overexposed(d.edges(t), d.entities(t), d.edges(t).select("article_id"), FRACTION, FLOOR)


DF = "(SELECT l_partkey AS entity_id, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY 1)"
NAMED = f"(SELECT df.entity_id, e.name, e.entity_type, df.df, lower(e.name) AS key, string_split(lower(e.name), ' ') AS w FROM {DF} df JOIN {d.ENTITIES} e ON e.entity_id = df.entity_id)"
GROUPS = f"""(SELECT n.entity_id, coalesce((SELECT min_by(o.target, i.i) FROM (SELECT unnest(range(2, len(n.w) + 1)) AS i) i JOIN (SELECT entity_type, key, min(entity_id) AS target FROM {NAMED} GROUP BY 1, 2) o
ON o.entity_type = n.entity_type AND o.key = array_to_string(n.w[i.i:], ' ') AND o.target <> n.entity_id), n.entity_id) AS group_id, n.df FROM {NAMED} n)"""
OVER = f"(SELECT entity_id, group_id, exposure FROM (SELECT *, CAST(sum(df) OVER (PARTITION BY group_id) AS BIGINT) AS exposure FROM {GROUPS}) WHERE exposure > (SELECT greatest({FLOOR}, ceil(count(DISTINCT l_orderkey) * {FRACTION})) FROM lineitem))"


@query(f"SELECT * FROM {DF}")
def entity_df(t: Tables):
    return guard.document_frequency(d.edges(t))


@query(f"SELECT count(DISTINCT l_orderkey) AS corpus, CAST(greatest({FLOOR}, ceil(count(DISTINCT l_orderkey) * {FRACTION})) AS BIGINT) AS ceiling FROM lineitem")
def overexposure_threshold(t: Tables):
    return guard.threshold(d.edges(t).select("article_id"), FRACTION, FLOOR)


@query(f"SELECT entity_id, group_id FROM {GROUPS}")
def alias_groups(t: Tables):
    known = d.entities(t).join(d.edges(t).select("entity_id").distinct(), "entity_id", "left_semi")
    return guard.alias_groups(known)


@query(f"SELECT * FROM {OVER}")
def overexposed_entities(t: Tables):
    return _over(t)


def _domains(t: Tables):
    """Each article's publisher: that of its first line; named like an entity now and then."""
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("article_id")).agg(F.min("l_partkey").alias("p"))
    ents = d.entities(t).select(F.col("entity_id").alias("p"), F.concat(F.lit("www."), F.regexp_replace(F.lower("name"), "[^a-z0-9]", "-"), F.lit(".com")).alias("domain"))
    own = first.join(ents, "p", "left")
    return own.select("article_id", F.when(F.col("article_id") % 2 == 0, F.col("domain")).otherwise("example.org").alias("domain"))


DOMAINS = f"(SELECT article_id, CASE WHEN article_id % 2 = 0 THEN 'www.' || regexp_replace(lower(e.name), '[^a-z0-9]', '-', 'g') || '.com' ELSE 'example.org' END AS domain FROM (SELECT l_orderkey AS article_id, min(l_partkey) AS p FROM lineitem GROUP BY 1) LEFT JOIN {d.ENTITIES} e ON e.entity_id = p)"
LABELS = "list_transform(list_filter(string_split(regexp_replace(lower(domain), '^www\\.', ''), '.'), lambda x: x <> '' AND x NOT IN ('com', 'org', 'net', 'gov', 'edu', 'co', 'uk', 'us', 'io', 'news')), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g'))"
A_GUARD = f"(SELECT DISTINCT l_orderkey AS article_id, l_partkey AS entity_id FROM lineitem JOIN {d.ENTITIES} e ON e.entity_id = l_partkey JOIN {DOMAINS} dm ON dm.article_id = l_orderkey WHERE e.entity_type <> 'OTHER' AND l_partkey NOT IN (SELECT entity_id FROM {OVER}) AND NOT list_contains(coalesce({LABELS}, []), regexp_replace(lower(e.name), '[^a-z0-9]', '', 'g')))"


@query(f"SELECT * FROM {A_GUARD}")
def article_guard(t: Tables):
    return guard.article_guard(d.edges(t), d.entities(t), _over(t), _domains(t))


def _story(t: Tables):
    """Stories of five articles: members, their edges and domains."""
    return d.edges(t).withColumn("story_id", F.floor(F.col("article_id") / 5))


S_GUARD = f"""(SELECT DISTINCT l_orderkey // 5 AS story_id, l_partkey AS entity_id FROM lineitem JOIN {d.ENTITIES} e ON e.entity_id = l_partkey
LEFT JOIN (SELECT article_id // 5 AS story_id, min(domain) AS domain FROM {DOMAINS} GROUP BY 1 HAVING count(DISTINCT domain) = 1) dm ON dm.story_id = l_orderkey // 5
WHERE e.entity_type <> 'OTHER' AND l_partkey NOT IN (SELECT entity_id FROM {OVER}) AND NOT list_contains(coalesce({LABELS}, []), regexp_replace(lower(e.name), '[^a-z0-9]', '', 'g')))"""


def _members(domains):
    return domains.select(F.floor(F.col("article_id") / 5).alias("story_id"), "domain")


@query(f"SELECT * FROM {S_GUARD}")
def story_guard(t: Tables):
    return guard.story_guard(_story(t), d.entities(t), _over(t), _members(_domains(t)))


SHARED = f"SELECT a.article_id, s.story_id, count(*) AS shared FROM {A_GUARD} a JOIN {S_GUARD} s ON a.entity_id = s.entity_id GROUP BY 1, 2"


@query(SHARED)
def shared_guard(t: Tables):
    """Guard entities that each article shares with each story. What both guards need is worked out once."""
    with work.tables(t.spark) as table, work.released(t.spark):
        over, domains = table(_over(t)), table(_domains(t))
        articles = guard.article_guard(d.edges(t), d.entities(t), over, domains)
        stories = guard.story_guard(_story(t), d.entities(t), over, _members(domains))
        return guard.shared(articles, "article_id", stories, "story_id")


@query(SHARED)
def shared_guard_all(t: Tables):
    """shared_guard, under its earlier name."""
    return shared_guard(t)


@query("SELECT l_orderkey AS story_id, count(DISTINCT l_suppkey) AS source_count FROM lineitem GROUP BY 1")
def story_source_count(t: Tables):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("story_id")).agg(F.countDistinct("l_suppkey").alias("source_count"))


@query("SELECT l_orderkey // 5 AS story_id, l_partkey AS entity_id, CAST(sum(l_linenumber) AS BIGINT) AS mention_count FROM lineitem GROUP BY 1, 2")
def story_entity_resync(t: Tables):
    members = t.orders.select((F.floor(F.col("o_orderkey") / 5)).alias("story_id"), F.col("o_orderkey").alias("article_id"))
    return clustering.resync(members, d.edges(t))


@query("""WITH RECURSIVE f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey - 1 END AS up FROM orders),
r AS (SELECT id, id AS top, up FROM f UNION ALL SELECT r.id, f.id, f.up FROM r JOIN f ON f.id = r.up) SELECT id AS story_id, top AS root FROM r WHERE up IS NULL""")
def merge_roots(t: Tables):
    forest = t.orders.select(F.col("o_orderkey").alias("story_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") - 1).alias("merged_into_id"))
    return clustering.resolve_merged(forest)

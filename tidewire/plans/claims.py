"""Claims over orders (claims) and lineitem (evidence); scores of stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import claims as ops
from tidewire.operators import scoring

from . import domain as d
from .registry import Tables, query

AUTH = ", ".join(map(str, d.AUTHORITIES))
HOME = ", ".join(map(str, d.HOME))


def _evidence(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").isin(*d.AUTHORITIES).alias("is_authority"))
    content = F.when(F.col("l_quantity") > 2, F.md5(F.col("l_partkey").cast("string")))
    rows = t.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("source_id"), content.alias("content_hash"), F.col("l_shipdate").alias("asserted_at"))
    return rows.join(s, "source_id")


EVIDENCE = f"(SELECT l_orderkey AS claim_id, l_suppkey AS source_id, s_nationkey IN ({AUTH}) AS is_authority, CASE WHEN l_quantity > 2 THEN md5(CAST(l_partkey AS VARCHAR)) END AS content_hash, l_shipdate AS asserted_at FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"
STATUS = f"(SELECT o_orderkey AS claim_id, coalesce((CASE WHEN a THEN 'authoritative' WHEN s >= 2 AND c >= 2 THEN 'corroborated' ELSE 'single_source' END), 'unverified') AS verification_status FROM orders LEFT JOIN (SELECT claim_id, bool_or(is_authority) AS a, count(DISTINCT source_id) AS s, count(DISTINCT content_hash) AS c FROM {EVIDENCE} GROUP BY 1) ON claim_id = o_orderkey)"
STATUS = STATUS.replace("coalesce((CASE WHEN a", "coalesce((CASE WHEN s IS NULL THEN NULL WHEN a")


def _claims(t: Tables):
    claims = t.orders.select(F.col("o_orderkey").alias("claim_id"), F.lit("unverified").alias("verification_status"))
    return ops.verify(claims, _evidence(t))


@query(f"SELECT claim_id, verification_status FROM {STATUS}")
def verification_status(t: Tables):
    return _claims(t)


@query(f"SELECT claim_id, count(DISTINCT source_id) AS supporting_source_count, min(asserted_at) AS first_asserted_at FROM {EVIDENCE} GROUP BY 1")
def supporting_sources(t: Tables):
    return ops.support(_evidence(t))


PAIRS = "(SELECT l_orderkey * 10 + l_linenumber AS ord, l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_linenumber = 1 AND l_orderkey <> l_partkey)"


@query(f"""WITH st AS {STATUS}, p AS (SELECT ord, a AS claim_id, b AS other FROM {PAIRS} UNION ALL SELECT ord, b, a FROM {PAIRS}),
w AS (SELECT p.claim_id, ord, other, CASE WHEN o.verification_status = 'authoritative' AND c.verification_status <> 'authoritative' THEN 2 WHEN c.verification_status = 'authoritative' AND o.verification_status <> 'authoritative' THEN 0 ELSE 1 END AS w
FROM p JOIN st c ON c.claim_id = p.claim_id JOIN st o ON o.claim_id = p.other),
g AS (SELECT claim_id, max(w) AS w, string_agg(other || ':' || ord % 7, ',' ORDER BY ord, other) AS contradicted_by FROM w WHERE w > 0 GROUP BY 1)
SELECT st.claim_id, CASE WHEN w = 2 THEN 'refuted' WHEN w = 1 THEN 'disputed' ELSE verification_status END AS verification_status, CASE WHEN st.claim_id % 2 = 0 THEN '-1:old' || coalesce(',' || contradicted_by, '') ELSE coalesce(contradicted_by, '') END AS contradicted_by FROM st LEFT JOIN g ON g.claim_id = st.claim_id""")
def contradiction_resolution(t: Tables):
    """Every second claim has an entry already; new ones, with their reasons, come behind it."""
    ord_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    pairs = t.lineitem.where("l_linenumber = 1 AND l_orderkey <> l_partkey").select(ord_.alias("ord"), F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), (ord_ % 7).cast("string").alias("reason"))
    had = F.when(F.col("claim_id") % 2 == 0, F.array(F.struct(F.lit(-1).cast("bigint").alias("claim_id"), F.lit("old").alias("reason"))))
    out = ops.contradictions(_claims(t).withColumn("had", had), pairs, "had")
    return out.withColumn("contradicted_by", F.array_join(F.transform("contradicted_by", lambda e: F.concat(e["claim_id"], F.lit(":"), e["reason"])), ","))


KIND = "CASE l_linenumber % 4 WHEN 0 THEN 'FACT' WHEN 1 THEN 'CLAIM' WHEN 2 THEN 'OPINION' ELSE 'ANALYSIS' END"


@query(f"SELECT story_id, claim, kind FROM (SELECT *, count(*) OVER (PARTITION BY story_id) AS n FROM (SELECT l_orderkey AS story_id, l_partkey AS claim, {KIND} AS kind FROM lineitem) WHERE kind IN ('FACT', 'CLAIM', 'ALLEGATION', 'OFFICIAL_STATEMENT', 'PROJECTION')) WHERE n >= 2")
def checkable_claims(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("story_id"), F.col("l_partkey").alias("claim"), F.expr(KIND).alias("claim_type"))
    return ops.checkable(rows).select("story_id", "claim", F.col("claim_type").alias("kind"))


@query("""SELECT story_id, claim_text, claim_type FROM (SELECT l_orderkey AS story_id, CAST(l_partkey AS VARCHAR) AS claim_text, l_returnflag AS claim_type FROM lineitem WHERE l_linenumber > 3 AND NOT (l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 3) AND l_orderkey % 5 <> 0))
UNION ALL SELECT DISTINCT l_orderkey, CAST(l_partkey AS VARCHAR), l_returnflag FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber <= 3 AND l_orderkey % 5 <> 0""")
def claim_store(t: Tables):
    """Claims on record (lines above 3) replaced by extracted ones (lines to 3); stories divisible by 5 failed."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("story_id"), F.col("l_partkey").cast("string").alias("claim_text"), F.col("l_returnflag").alias("claim_type"), F.col("l_suppkey").alias("article_id"), "l_linenumber")
    now = rows.where("l_linenumber > 3").select("story_id", "claim_text", "claim_type")
    new = rows.where("l_linenumber <= 3")
    return ops.store(now, new, t.supplier.select(F.col("s_suppkey").alias("article_id")), rows.where("story_id % 5 = 0").select("story_id").distinct())


MARKER = "e.name LIKE 'red%'"
SIGNALS = f"""(SELECT coalesce(x.story_id, y.story_id) AS story_id, coalesce(es, 0.0) AS es, coalesce(ps, 0.0) AS ps, coalesce(us, 0) AS us, coalesce(total, 0) AS total FROM
(SELECT l_orderkey AS story_id, count(DISTINCT CASE WHEN {MARKER} THEN name END) / count(*) AS es FROM lineitem JOIN {d.ENTITIES} e ON e.entity_id = l_partkey WHERE entity_type <> 'OTHER' GROUP BY 1) x
FULL JOIN (SELECT l_orderkey AS story_id, count(*) FILTER (WHERE s_nationkey IN ({HOME})) / count(*) AS ps, count(*) FILTER (WHERE s_nationkey IN ({HOME})) AS us, count(*) AS total FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) y ON x.story_id = y.story_id)"""


def _scored(t: Tables):
    ents = d.edges(t).join(d.entities(t), "entity_id").select(F.col("article_id").alias("story_id"), "name", "entity_type")
    return scoring.relevance(ents, d.members(t), F.col("name").like("red%"), "US")


@query(f"SELECT story_id, CAST(round_even(100 * (0.6 * es + 0.4 * ps), 0) AS INTEGER) AS score, round_even(es, 4) AS entity_signal, round_even(ps, 4) AS publisher_signal, us AS us_sources, total AS total_sources FROM {SIGNALS}")
def us_relevance_score(t: Tables):
    return _scored(t).select("story_id", "score", F.bround("entity_signal", 4).alias("entity_signal"), F.bround("publisher_signal", 4).alias("publisher_signal"), "us_sources", "total_sources")


BASIS = f"""'{{"formula_version":1,"coverage":{scoring.COVERAGE},"signals":{{"us_entities":{{"weight":{scoring.WEIGHT_ENTITIES},"value":' || (round_even(es, 4) + 0.0) || '}},"us_publisher_share":{{"weight":{scoring.WEIGHT_PUBLISHERS},"value":' || (round_even(ps, 4) + 0.0) || ',"us_sources":' || us || ',"total_sources":' || total || '}}}}}}'"""


@query(f"SELECT story_id, CAST(round_even(100 * (0.6 * es + 0.4 * ps), 0) AS INTEGER) AS score, {BASIS} AS basis FROM {SIGNALS}")
def us_relevance_basis(t: Tables):
    return scoring.basis(_scored(t)).select("story_id", "score", "basis")


@query("""SELECT article_id, entity_id, round_even(n / sum(n) OVER (PARTITION BY article_id), 3) AS salience FROM (SELECT l_orderkey AS article_id, l_partkey AS entity_id, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2)""")
def entity_salience(t: Tables):
    per = d.edges(t).groupBy("article_id", "entity_id").agg(F.sum("mention_count").alias("n"))
    return scoring.salience(per).select("article_id", "entity_id", "salience")

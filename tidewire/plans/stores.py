"""Stores, queues' payloads, labels and bundles over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import text, vectors
from tidewire.operators import clustering, guard, queues, serving, stores, upkeep

from . import domain as d
from .registry import Tables, query
from .vectors import ENT, NEAR, SHARE, _entities, _probes, _rows

OK = "list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))"


@query(f"""WITH b AS (SELECT *, vec_id // 50 AS batch FROM embeddings), g AS (SELECT batch FROM b GROUP BY 1 HAVING bool_and(len(embedding) = 64 AND abs(sqrt({OK}) - 1) <= 0.05) AND batch % 3 <> 0)
SELECT doc_id AS article_id, g.batch IS NOT NULL AS stored FROM documents LEFT JOIN b ON b.vec_id = doc_id LEFT JOIN g ON g.batch = b.batch""")
def embedding_store(t: Tables):
    """Vectors sent in batches of fifty; one vector of every third batch lacks a number, so the batch is refused."""
    first = F.col("vec_id") % 150 == 0
    sent = t.embeddings.select(F.floor(F.col("vec_id") / 50).alias("batch"), F.col("vec_id").alias("article_id"), F.when(first, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"))
    none = F.lit(None)
    arts = t.documents.select(F.col("doc_id").alias("article_id"), none.cast("array<float>").alias("embedding"), none.cast("timestamp").alias("embedded_at"))
    return stores.store_vectors(arts, sent, 64, d.now()).select("article_id", F.col("embedded_at").isNotNull().alias("stored"))


@query("""WITH k AS (SELECT l_orderkey AS a, l_partkey AS e, l_linenumber AS m FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey, l_suppkey, 1 FROM lineitem WHERE l_orderkey % 4 = 0 AND l_orderkey % 8 <> 0)
SELECT a // 5 AS story_id, e AS entity_id, CAST(sum(m) AS BIGINT) AS mention_count FROM k JOIN orders ON o_orderkey = a GROUP BY 1, 2""")
def entity_store(t: Tables):
    """Every fourth article is tagged anew, every eighth has no entity now; story sets follow."""
    sent = t.lineitem.where("l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("article_id"), F.when(F.col("l_orderkey") % 8 != 0, F.col("l_suppkey")).alias("entity_id"), F.lit(1).cast("bigint").alias("mention_count"))
    members = t.orders.select(F.floor(F.col("o_orderkey") / 5).alias("story_id"), F.col("o_orderkey").alias("article_id"))
    return stores.store_entities(d.edges(t), sent, members)[1]


@query("""WITH c AS (SELECT l_orderkey AS story_id, l_linenumber AS ord, l_suppkey AS s, l_shipdate AS shipped FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 5 <> 0 AND l_suppkey % 4 <> 0),
k AS (SELECT story_id, ord, count(DISTINCT s % 7) AS sources, min(shipped) AS first_at FROM c GROUP BY 1, 2)
SELECT o_orderkey AS story_id, CASE WHEN x.story_id IS NULL OR o_orderkey % 5 = 0 THEN 'standard' WHEN o_orderkey % 3 = 0 THEN 'high' ELSE 'elevated' END AS risk_tier, x.story_id IS NOT NULL AS extracted,
CASE WHEN x.story_id IS NULL OR o_orderkey % 5 = 0 THEN 1 ELSE coalesce(n, 0) END AS claims, CASE WHEN x.story_id IS NULL OR o_orderkey % 5 = 0 THEN 0 ELSE coalesce(sources, 0) END AS sources,
CASE WHEN o_orderkey % 5 <> 0 THEN first_at END AS first_asserted_at
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS story_id FROM lineitem WHERE l_linenumber <= 3) x ON x.story_id = o_orderkey
LEFT JOIN (SELECT story_id, count(*) AS n, CAST(sum(sources) AS BIGINT) AS sources, min(first_at) AS first_at FROM k GROUP BY 1) q ON q.story_id = o_orderkey""")
def claim_store_items(t: Tables):
    """A delivery for stories with lines up to 3: each line is evidence of the claim of its number; stories divisible by 5 failed, suppliers divisible by 4 aren't known."""
    rows = t.lineitem.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("story_id"), "l_linenumber", F.struct((F.col("l_suppkey") * 100_000 + F.datediff("l_shipdate", F.lit("1970-01-01"))).alias("article_id"), F.lit("q").alias("quote")).alias("e"))
    lists = rows.groupBy("story_id", "l_linenumber").agg(F.collect_list("e").alias("evidence"))
    # A claim's place in its list is its line: stories may lack lines, so places are filled.
    claim = lambda n: F.struct(F.concat(F.lit("c"), F.lit(n)).alias("claim_text"), F.lit("FACT").alias("claim_type"), F.lit(90).alias("confidence"), F.coalesce(F.max(F.when(F.col("l_linenumber") == n, F.col("evidence"))), F.array().cast("array<struct<article_id:bigint,quote:string>>")).alias("evidence"))
    items = lists.groupBy("story_id").agg(F.array(claim(1), claim(2), claim(3)).alias("claims"))
    failed = F.col("story_id") % 5 == 0
    items = items.select("story_id", F.when(failed, "no answer").alias("error"), F.when(~failed, F.when(F.col("story_id") % 3 == 0, "high").otherwise("elevated")).alias("risk_tier"), "claims")
    arts = t.lineitem.where("l_suppkey % 4 <> 0").select((F.col("l_suppkey") * 100_000 + F.datediff("l_shipdate", F.lit("1970-01-01"))).alias("article_id"), (F.col("l_suppkey") % 7).alias("source_id"), F.lit("u").alias("url"), F.col("l_shipdate").alias("published_at")).distinct()
    st = t.orders.select(F.col("o_orderkey").alias("story_id"), F.lit("standard").alias("risk_tier"), F.lit(False).alias("claims_extracted"))
    old = st.select("story_id", F.lit(0).alias("ord"), F.lit("old").alias("claim_text"), F.lit("FACT").alias("claim_type"), F.lit(50).alias("confidence"), F.lit(0).cast("bigint").alias("supporting_source_count"), F.lit(None).cast(arts.schema["published_at"].dataType).alias("first_asserted_at"))
    evidence = st.where("false").select("story_id", F.lit(0).alias("ord"), F.lit(0).cast("bigint").alias("article_id"), F.lit(0).cast("bigint").alias("source_id"), F.lit("").alias("url"), F.lit("").alias("quote"), F.lit("").alias("stance"))
    runs = st.where("false").select("story_id", F.lit("").alias("provider"), F.lit("").alias("status"), F.lit("").alias("error"))
    got = stores.store_claims(stores.ClaimStore(st, old, evidence, runs), items, arts, "claude-x")
    per = got.claims.groupBy("story_id").agg(F.count("*").alias("claims"), F.sum("supporting_source_count").alias("sources"), F.min("first_asserted_at").alias("first_asserted_at"))
    zero = F.lit(0).cast("bigint")
    return got.stories.join(per, "story_id", "left").select("story_id", "risk_tier", F.col("claims_extracted").alias("extracted"), F.coalesce("claims", zero).alias("claims"), F.coalesce("sources", zero).alias("sources"), "first_asserted_at")


HEAD = "(SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents QUALIFY r <= 200)"


@query(f"""SELECT batch, n, ids, CAST(length(list_aggregate(texts, 'string_agg', '')) AS BIGINT) AS chars FROM (SELECT batch, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n_chars, doc_id) AS ids, list(text) AS texts FROM
(SELECT *, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32 AS batch FROM {HEAD} WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE length(trim(coalesce(text, ''))) > 0 GROUP BY 1)""")
def dispatch_payloads(t: Tables):
    """The payloads of a tick's embedding jobs, read back."""
    backlog = t.documents.select(F.col("doc_id").alias("id"), "text", "n_chars")
    jobs = queues.dispatch(backlog, t.labels.select(F.col("doc_id").alias("id")), ["n_chars", "id"], 200, 32)
    items = F.from_json("payload", "items array<struct<id:string,text:string>>")["items"]
    read = jobs.select("batch", items.alias("i"))
    return read.select("batch", F.size("i").cast("bigint").alias("n"), F.array_join(F.transform("i", lambda x: x["id"]), ",").alias("ids"), F.length(F.array_join(F.transform("i", lambda x: x["text"]), "")).cast("bigint").alias("chars"))


@query("""SELECT batch, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, CAST(sum(n_claims) AS BIGINT) AS claims FROM
(SELECT id, (row_number() OVER (ORDER BY id) - 1) // 5 AS batch, n_claims FROM (SELECT l_orderkey AS id, count(*) AS n_claims FROM lineitem GROUP BY 1 HAVING count(*) >= 2 ORDER BY id LIMIT 40)) GROUP BY 1""")
def contradiction_payloads(t: Tables):
    """Stories with two claims or more, five a job, each with its claims and the names that they are attributed to."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", F.col("l_partkey").alias("attributed_to_entity_id"))
    named = stores.attributed(rows, d.entities(t).where("entity_id % 2 = 0"))
    item = F.struct(F.col("l_partkey").cast("string").alias("id"), F.col("attributed_to").alias("attributedTo"))
    many = rows.groupBy("id").count().where("count >= 2").select("id")
    st = queues.with_members(many, named, "id", ["l_linenumber", "l_partkey"], item, "claims").withColumn("text", F.lit("x"))
    jobs = queues.dispatch(st, st.where("false").select("id"), ["id"], 40, 5, F.struct(F.col("id").cast("string").alias("id"), "claims"))
    read = jobs.select("batch", "n", "ids", F.from_json("payload", "items array<struct<id:string,claims:array<struct<id:string,attributedTo:string>>>>")["items"].alias("i"))
    return read.select("batch", "n", F.array_join("ids", ",").alias("ids"), F.aggregate("i", F.lit(0).cast("bigint"), lambda s, x: s + F.size(x["claims"])).alias("claims"))


PAIRS = f"(SELECT probe_id AS story_id, row_id AS other_id, CASE WHEN x.label = y.label THEN 'same_event' WHEN probe_id % 200 = 0 THEN 'unsure' ELSE 'different' END AS verdict, similarity, coalesce(shared, 0) AS shared FROM {NEAR} n LEFT JOIN {SHARE} s ON s.a = probe_id AND s.b = row_id JOIN embeddings x ON x.vec_id = probe_id JOIN embeddings y ON y.vec_id = row_id WHERE rank <= 10)"


def _verdicts(t: Tables):
    """The ten nearest of each probe, judged by their labels."""
    near, g, lab = clustering.nearest(_probes(t), _rows(t), 10), _entities(t, "id"), t.embeddings.select("vec_id", "label")
    share = guard.shared(g.toDF("probe_id", "entity_id"), "probe_id", g.toDF("row_id", "entity_id"), "row_id")
    rows = near.join(share, ["probe_id", "row_id"], "left").join(lab.toDF("probe_id", "la"), "probe_id").join(lab.toDF("row_id", "lb"), "row_id")
    verdict = F.when(F.col("la") == F.col("lb"), "same_event").when(F.col("probe_id") % 200 == 0, "unsure").otherwise("different")
    return rows.select(F.col("probe_id").alias("story_id"), F.col("row_id").alias("other_id"), verdict.alias("verdict"), "similarity", F.coalesce("shared", F.lit(0).cast("bigint")).alias("shared"))


MARKS = f"(SELECT vec_id AS story_id, string_agg(CASE WHEN entity_id % 3 <> 0 THEN '+' ELSE '-' END || ' e' || entity_id || ' (ORG)', ', ' ORDER BY 'e' || entity_id) AS marks FROM {ENT} GROUP BY 1)"


@query(f"""SELECT p.story_id, other_id, CASE WHEN similarity < 0.82 AND shared = 0 THEN 'both' WHEN similarity < 0.82 THEN 'threshold' WHEN shared = 0 THEN 'guard' ELSE 'other' END AS blocked_by, a.marks, b.marks AS other_marks
FROM {PAIRS} p JOIN {MARKS} a ON a.story_id = p.story_id JOIN {MARKS} b ON b.story_id = other_id WHERE verdict = 'same_event'""")
def missed_joins(t: Tables):
    """Pairs that should have been one story, with both sides' entities; every third entity is too common here."""
    edges = _entities(t, "story_id")
    ents = edges.select("entity_id").distinct().select("entity_id", F.concat(F.lit("e"), "entity_id").alias("name"), F.lit("ORG").alias("entity_type"))
    marks = stores.entity_marks(edges, ents, edges.where("entity_id % 3 <> 0"))
    return stores.missed_joins(_verdicts(t), marks).drop("similarity")


@query(f"SELECT 71::BIGINT AS joined, count(*) FILTER (WHERE verdict = 'same_event') AS missed, count(*) AS judged, round_even(71 / (71 + count(*) FILTER (WHERE verdict = 'same_event')), 6) AS recall FROM {PAIRS}")
def pair_recall(t: Tables):
    return stores.recall(_verdicts(t), 71).withColumn("recall", F.bround("recall", 6))


@query("""SELECT o_orderkey AS id, coalesce(r.refs, '') AS refs, coalesce(c.n, 0) AS corrections, coalesce(g.tags, '') AS tags FROM orders
LEFT JOIN (SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey) AS refs FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) r ON r.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' GROUP BY 1) c ON c.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, string_agg(p_name || p_partkey, ',' ORDER BY p_name || p_partkey) AS tags FROM (SELECT DISTINCT l_orderkey, p_name, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber > 4) GROUP BY 1) g ON g.l_orderkey = o_orderkey""")
def article_bundle(t: Tables):
    """An article's references, public corrections and tags."""
    line = t.lineitem.withColumnRenamed("l_orderkey", "id")
    refs = line.where("l_linenumber <= 2").select("id", F.col("l_linenumber").alias("display_order"), F.col("l_suppkey").alias("ref_id"), F.lit("u").alias("url"))
    fixes = line.where("l_returnflag = 'R'").select("id", (F.col("l_linestatus") == "O").alias("is_public"), F.col("l_shipdate").alias("issued_at"), F.lit("s").alias("summary"))
    tags = t.part.select(F.col("p_partkey").alias("tag_id"), F.concat("p_name", "p_partkey").alias("slug"), F.col("p_name").alias("name"))
    own = line.where("l_linenumber > 4").select("id", F.col("l_partkey").alias("tag_id")).distinct()
    out = serving.bundle(t.orders.select(F.col("o_orderkey").alias("id")), refs, fixes, tags, own)
    return out.select("id", F.array_join(F.transform("refs", lambda r: r["ref_id"].cast("string")), ",").alias("refs"), F.size("corrections").cast("bigint").alias("corrections"), F.array_join(F.transform("tags", lambda g: g["slug"]), ",").alias("tags"))


@query(f"SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS source, coalesce(CASE WHEN l_partkey % 3 = 0 THEN e.name END, '') AS attributed_to FROM lineitem LEFT JOIN {d.ENTITIES} e ON e.entity_id = l_partkey")
def attributions(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("source"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey")).alias("attributed_to_entity_id"))
    return stores.attributed(rows, d.entities(t)).drop("attributed_to_entity_id")


@query(f"SELECT count(*) FILTER (WHERE s_nationkey IN ({', '.join(map(str, d.AUTHORITIES))})) AS authorities, count(*) FILTER (WHERE s_acctbal < 0) AS unclassified, count(*) AS sources FROM supplier")
def source_tallies(t: Tables):
    return t.supplier.agg(F.count_if(F.col("s_nationkey").isin(*d.AUTHORITIES)).alias("authorities"), F.count_if(F.col("s_acctbal") < 0).alias("unclassified"), F.count("*").alias("sources"))


@query(f"""SELECT count(*) FILTER (WHERE event_type = 'click') AS queued, CAST(floor((epoch_us(TIMESTAMP '{d.NOW}') - epoch_us(min(ts) FILTER (WHERE event_type = 'click'))) / 1000000) AS BIGINT) AS oldest_s,
count(*) FILTER (WHERE event_type = 'purchase' AND ts >= date_trunc('day', TIMESTAMP '{d.NOW}' - INTERVAL 2 DAY)) AS published_today FROM events""")
def queue_report(t: Tables):
    """Depth and age of a queue, and what was published since midnight two days ago: one pass."""
    from tidewire.functions import moments

    queued = F.col("event_type") == "click"
    since = F.date_trunc("day", d.now() - F.expr("INTERVAL 2 DAYS"))
    got = t.events.agg(F.count_if(queued).alias("queued"), F.min(F.when(queued, F.col("ts"))).alias("oldest"), F.count_if((F.col("event_type") == "purchase") & (F.col("ts") >= since)).alias("published_today"))
    return got.select("queued", moments.age_seconds(F.col("oldest"), d.now()).alias("oldest_s"), "published_today")


PLACES = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber = 1 DESC, l_quantity NULLS LAST, l_partkey, l_suppkey, l_extendedprice)"


@query(f"SELECT l_orderkey AS story_id, l_partkey AS article_id, l_suppkey AS source_id, l_linenumber = 1 AS is_primary, CAST({PLACES} AS INTEGER) AS number FROM lineitem")
def placements_numbered(t: Tables):
    """A story's placements, the founder first, then by similarity, numbered for the answers."""
    rows = t.lineitem.select("*", (F.col("l_linenumber") == 1).alias("is_primary"))
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("is_primary"), F.asc_nulls_last("l_quantity"), "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select(F.col("l_orderkey").alias("story_id"), F.col("l_partkey").alias("article_id"), F.col("l_suppkey").alias("source_id"), "is_primary", F.row_number().over(w).alias("number"))


@query("""SELECT user_id, day, n, CAST(v - lag(v) OVER w AS BIGINT) AS acceleration, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM
(SELECT *, n - lag(n) OVER (PARTITION BY user_id ORDER BY day) AS v FROM (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)) WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def signal_acceleration(t: Tables):
    """Signals a day, how their change changes, and their sum over seven days."""
    per = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("d")
    week = F.sum("n").over(Window.partitionBy("user_id").orderBy(F.unix_date("d")).rangeBetween(-6, 0))
    out = per.withColumn("v", F.col("n") - F.lag("n").over(w)).withColumn("week", week)
    return out.select("user_id", F.col("d").cast("timestamp_ntz").alias("day"), "n", (F.col("v") - F.lag("v").over(w)).alias("acceleration"), "week")


@query("SELECT l_orderkey AS story_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def multi_claim_stories(t: Tables):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("story_id")).agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT l_orderkey AS story_id, l_partkey AS article_id FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 5)")
def busy_stories(t: Tables):
    busy = t.lineitem.groupBy("l_orderkey").count().where("count > 5").select("l_orderkey")
    return t.lineitem.join(busy, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("story_id"), F.col("l_partkey").alias("article_id"))


@query("""SELECT l_orderkey AS story_id, CAST(len(list_intersect(list_distinct(list(l_partkey) FILTER (WHERE l_linenumber <= 3)), list_distinct(list(l_partkey) FILTER (WHERE l_linenumber > 3)))) AS BIGINT) AS in_both FROM lineitem GROUP BY 1
HAVING count(*) FILTER (WHERE l_linenumber <= 3) > 0 AND count(*) FILTER (WHERE l_linenumber > 3) > 0""")
def guard_intersection(t: Tables):
    """Entities that a story has before and after: a set intersection of two arrays."""
    first, later = F.when(F.col("l_linenumber") <= 3, F.col("l_partkey")), F.when(F.col("l_linenumber") > 3, F.col("l_partkey"))
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("story_id")).agg(F.collect_set(first).alias("x"), F.collect_set(later).alias("y")).where("size(x) > 0 AND size(y) > 0")
    return per.select("story_id", F.size(F.array_intersect("x", "y")).cast("bigint").alias("in_both"))


@query("""WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings), f AS (SELECT label, min(vec_id) AS founder FROM embeddings GROUP BY 1)
SELECT e.label, founder, CAST(place - 1 AS INTEGER) AS place, round_even(avg(x), 6) + 0.0 AS mean FROM e JOIN f ON f.label IS NOT DISTINCT FROM e.label GROUP BY 1, 2, 3""")
def story_means(t: Tables):
    """Each label's first vector by id founds it; its mean is that of all its vectors, at every place."""
    founder = t.embeddings.groupBy(F.col("label").alias("of")).agg(F.min("vec_id").alias("founder"))
    means = vectors.mean_vector(t.embeddings, "label", "embedding").select("label", F.posexplode("centroid").alias("place", "x"))
    return means.join(founder, F.col("label").eqNullSafe(F.col("of"))).select("label", "founder", "place", (F.bround("x", 6) + F.lit(0.0)).alias("mean"))


@query(f"""SELECT (SELECT count(*) FROM orders) AS articles, (SELECT count(*) FROM {d.ARTICLES} WHERE status = 'published') AS published, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS stories,
(SELECT count(*) FROM lineitem) AS placements, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed_jobs""")
def pipeline_status(t: Tables):
    """The stages' counts in one row: four aggregations, each over its table once."""
    arts = d.articles(t).agg(F.count("*").alias("articles"), F.count_if(F.col("status") == "published").alias("published"))
    st = t.lineitem.agg(F.countDistinct("l_orderkey").alias("stories"), F.count("*").alias("placements"))
    jobs = t.events.agg(F.count_if(F.col("event_type") == "error").alias("failed_jobs"))
    return arts.join(F.broadcast(st)).join(F.broadcast(jobs))  # a row each


@query("""SELECT doc_id, '{"quality":1}' AS before, '{"quality":0}' AS after FROM labels WHERE doc_id % 10 = 0 AND quality = 1""")
def audit_rows(t: Tables):
    """What corrections changed, before and after."""
    before = t.labels.select("doc_id", "quality")
    fixes = t.labels.where("doc_id % 10 = 0").select("doc_id", F.lit(1).alias("expected"), F.lit(0).alias("value")).distinct()
    after = upkeep.guarded_update(before, fixes, "doc_id", "quality")
    return upkeep.audit(before, after, "doc_id", ["quality"], "reviewer", d.now()).select("doc_id", "before", "after")


@query("""SELECT event_id, '{"at":"*","inner":{"k":"*","n":' || user_id || '},"list":[{"k":"*"}]}' AS masked FROM events""")
def masked_payloads(t: Tables):
    """Payloads with the values of volatile keys masked, at any depth."""
    from tidewire.functions import jsons

    raw = F.concat(F.lit('{"at": "'), F.col("ts").cast("string"), F.lit('", "inner": {"n": '), "user_id", F.lit(', "k": 1}, "list": [{"k": 2}]}'))
    return t.events.select("event_id", jsons.mask_keys(raw, F.lit("k,at")).alias("masked"))


@query("""SELECT event_id AS key, '$.items[id=' || event_id || '].n' AS path, 'changed' AS kind, CAST(user_id AS VARCHAR) AS was, CAST(user_id + 1 AS VARCHAR) AS now FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, '$.type', 'missing', '"' || event_type || '"', NULL FROM events WHERE event_id % 5 = 0 AND event_id % 11 <> 0 UNION ALL SELECT event_id, '$.extra', 'extra', NULL, '[]' FROM events WHERE event_id % 7 = 0 AND event_id % 11 <> 0
UNION ALL SELECT event_id, '$status', 'changed', '200', '404' FROM events WHERE event_id % 11 = 0 AND event_id % 3 <> 0 UNION ALL SELECT event_id, '$status', 'changed', '200', '404' FROM events WHERE event_id % 33 = 0
UNION ALL SELECT event_id, '$.type', 'missing', '"' || event_type || '"', NULL FROM events WHERE event_id % 55 = 0 UNION ALL SELECT event_id, '$.extra', 'extra', NULL, '[]' FROM events WHERE event_id % 77 = 0""")
def golden_differences(t: Tables):
    """Recorded answers against later ones: some changed a number, lost or got a field, or answer with another status; items come in another order, times are masked."""
    from tidewire.operators import golden

    e, has = t.events, lambda n: F.col("event_id") % n == 0
    item = lambda i, n: F.concat(F.lit('{"id":'), i, F.lit(',"n":'), n, F.lit("}"))
    one, other = item(F.col("event_id").cast("string"), F.col("user_id").cast("string")), item(F.lit("-1"), F.lit("0"))
    kind = F.concat(F.lit(',"type":"'), "event_type", F.lit('"'))
    was = F.concat(F.lit('{"at":1,"items":['), one, F.lit(","), other, F.lit("]"), kind, F.lit("}"))
    moved = item(F.col("event_id").cast("string"), (F.col("user_id") + F.when(has(3), 1).otherwise(0)).cast("string"))
    now = F.concat(F.lit('{"at":2,"items":['), other, F.lit(","), moved, F.lit("]"), F.when(has(5), "").otherwise(kind), F.when(has(7), ',"extra":[]').otherwise(""), F.lit("}"))
    before = e.select(F.col("event_id").alias("key"), F.lit(200).alias("status"), was.alias("body"))
    after = e.select(F.col("event_id").alias("key"), F.when(has(11), 404).otherwise(200).alias("status"), now.alias("body"))
    return golden.differences(golden.capture(before, ["at"]), golden.capture(after, ["at"]))


@query("""SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9'']+)', 1)) AS n_tokens, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9'']+)', 1))) AS n_distinct FROM documents""")
def body_token_counts(t: Tables):
    """Tokens of whole bodies; token_counts has those that a fingerprint reads."""
    words = text.tokens(F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"))


FEATURES = "(SELECT doc_id AS id, ('0x' || substr(md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9'']+)', 1))), 1, 8))::BIGINT % 262144 AS f FROM documents)"


@query(f"""WITH w AS (SELECT f, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(DISTINCT id))) + 1 AS w FROM {FEATURES} GROUP BY 1),
v AS (SELECT id, f % 64 AS place, sum(CASE WHEN (f // 64) % 2 = 1 THEN w ELSE -w END) AS x FROM {FEATURES} JOIN w USING (f) GROUP BY 1, 2),
l AS (SELECT id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1), p AS (SELECT doc_id AS id, CAST(unnest(range(64)) AS INTEGER) AS place FROM documents)
SELECT p.id, p.place, round_even(coalesce(x / nullif(norm, 0), 0), 6) + 0.0 AS x FROM p LEFT JOIN v ON v.id = p.id AND v.place = p.place LEFT JOIN l ON l.id = p.id""")
def hashed_vectors(t: Tables):
    """Documents' vectors by signed feature hashing."""
    from tidewire.operators import encoding

    out = encoding.hashed_vectors(t.documents.select(F.col("doc_id").alias("id"), "text"))
    return out.select("id", F.posexplode("vector").alias("place", "x")).select("id", "place", (F.bround("x", 6) + F.lit(0.0)).alias("x"))


@query()
def gazetteer_mentions(t: Tables):
    """Where whole documents say a name: the first two words of every other document, which copies and common passages repeat, and the parts' names."""
    from tidewire.operators import tagging

    head = F.slice(text.tokens(F.coalesce("text", F.lit(""))), 1, 2)
    names = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("entity_id"), F.array_join(head, " ").alias("name"))
    names = names.unionByName(t.part.select((-F.col("p_partkey")).alias("entity_id"), F.col("p_name").alias("name")))
    return tagging.counts(tagging.mentions(t.documents.select(F.col("doc_id").alias("id"), "text"), names))


MERGED = "(SELECT l_orderkey // 20 * 4 AS story_id, l_orderkey AS article_id, 'h' || (l_suppkey % 9) AS domain FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 20 < 15 UNION ALL SELECT l_orderkey // 5, l_orderkey, 'h' || (l_suppkey % 9) FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 20 >= 15)"


@query(f"""SELECT o.story_id, outlets, members, coalesce(entities, 0) AS entities, coalesce(mentions, 0) AS mentions, round_even(first, 6) + 0.0 AS first_place, round_even(last, 6) + 0.0 AS last_place FROM
(SELECT story_id, count(DISTINCT domain) AS outlets, count(*) AS members FROM {MERGED} GROUP BY 1) o
LEFT JOIN (SELECT story_id, count(DISTINCT l_partkey) AS entities, CAST(sum(l_linenumber) AS BIGINT) AS mentions FROM {MERGED} m JOIN lineitem ON l_orderkey = article_id GROUP BY 1) e ON e.story_id = o.story_id
LEFT JOIN (SELECT story_id, avg(embedding[1]::DOUBLE) AS first, avg(embedding[64]::DOUBLE) AS last FROM {MERGED} m JOIN embeddings ON vec_id = article_id GROUP BY 1) v ON v.story_id = o.story_id""")
def merge_application(t: Tables):
    """Stories of five articles; of every four, the second and third merge into the first. What is kept about them is moved, not counted again."""
    from tidewire.operators import merging

    first = t.lineitem.where("l_linenumber = 1")
    members = first.select(F.floor(F.col("l_orderkey") / 5).alias("story_id"), F.col("l_orderkey").alias("article_id"), F.concat(F.lit("h"), F.col("l_suppkey") % 9).alias("domain"))
    vecs = t.embeddings.select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vector"))
    kept = merging.counted(members, vecs, d.edges(t))
    merges = members.select("story_id").distinct().where("story_id % 4 IN (1, 2)").select((F.col("story_id") - F.col("story_id") % 4).alias("survivor_id"), F.col("story_id").alias("absorbed_id"))
    out = merging.summary(merging.after_merges(kept, merges))
    zero, r = F.lit(0).cast("bigint"), lambda c: F.bround(c, 6) + F.lit(0.0)
    return out.select("story_id", "outlets", "members", F.coalesce("entities", zero).alias("entities"), F.coalesce("mentions", zero).alias("mentions"), r(F.get("mean", F.lit(0))).alias("first_place"), r(F.get("mean", F.lit(63))).alias("last_place"))


@query("SELECT page_id, CAST(length(url) AS BIGINT) AS before, host FROM (SELECT page_id, url, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)")
def registered_functions(t: Tables):
    """The library's functions by name in SQL: hosts of canonical URLs."""
    from tidewire.functions import register

    register.register(t.spark)
    t.pages.createOrReplaceTempView("tidewire_pages")
    return t.spark.sql("SELECT page_id, CAST(length(url) AS BIGINT) AS before, lower(parse_url(tw_canonical_url(url), 'HOST')) AS host FROM tidewire_pages")


@query()
def cluster_events(t: Tables):
    """Join-or-create over articles with dates of years and entities of lineitem: many components, cut at gaps of days."""
    vec = t.embeddings.select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vector"))
    host = F.concat(F.lit("h"), F.col("o_custkey") % 40, F.lit(".com"))
    arts = t.orders.select(F.col("o_orderkey").alias("article_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"), host.alias("domain")).join(vec, "article_id")
    over = guard.overexposed(d.edges(t), d.entities(t), d.edges(t).select("article_id"), 0.01, 5)
    return clustering.cluster(arts, d.edges(t).select("article_id", "entity_id").distinct(), d.entities(t), over, 0.2)

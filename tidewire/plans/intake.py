"""What models and feeds send, and who may show what, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import moments, text, vectors
from tidewire.operators import answers, queues, serving

from . import domain as d
from .registry import Tables, query


@query("""SELECT doc_id, n_chars % 7 = 0 AS flagged_top_level, n_chars % 7 = 0 OR n_chars % 3 = 0 OR n_chars % 5 = 0 AS flagged_any FROM documents""")
def flags_merged(t: Tables):
    """Items whose titles (every third), bodies (every fifth) or own lists (every seventh) hold a pattern."""
    hits = lambda k: F.when(F.col("n_chars") % k == 0, F.array(F.lit("disregard"))).otherwise(F.array().cast("array<string>"))
    merged = answers.merged_flags(hits(3), hits(5), F.lit(0))
    flags = F.when(F.col("n_chars") % 7 == 0, F.replace(merged, F.lit('"patterns":[]'), F.lit('"patterns":["x"]'))).otherwise(merged)
    rows = t.documents.select("doc_id", flags.alias("flags"))
    return rows.select("doc_id", answers.flagged_top_level(F.col("flags")).alias("flagged_top_level"), answers.flagged_any(F.col("flags")).alias("flagged_any"))


@query(f"SELECT '{{' || string_agg('\"' || status || '\":' || n, ',' ORDER BY status) || '}}' AS counts FROM (SELECT status, count(*) AS n FROM {d.ARTICLES} GROUP BY 1)")
def status_map(t: Tables):
    per = d.articles(t).groupBy("status").agg(F.count("*").alias("n"))
    return answers.as_map(per, "status", "n").select(F.to_json("map").alias("counts"))


KINDS = "['FACT', 'CLAIM', 'RUMOUR', 'OPINION', 'ALLEGATION']"
WHO = "CASE WHEN l_suppkey % 2 = 0 THEN 'S' || l_suppkey END"


@query(f"""SELECT story_id, line, part, CASE WHEN line = 7 THEN 'malformed' WHEN l_quantity = 1 THEN 'risk_tier' WHEN kind = 'RUMOUR' THEN 'claim_type' WHEN l_quantity > 45 THEN 'confidence' WHEN line = 6 THEN 'evidence'
WHEN kind IN ('CLAIM', 'ALLEGATION') AND who IS NULL THEN 'attributed_to' END AS problem
FROM (SELECT *, l_orderkey AS story_id, l_linenumber AS line, l_partkey AS part, {KINDS}[l_partkey % 5 + 1] AS kind, {WHO} AS who FROM lineitem)""")
def claim_answers(t: Tables):
    """Answers about each line: some are cut short, some break a rule."""
    kind = F.element_at(F.array(*map(F.lit, ("FACT", "CLAIM", "RUMOUR", "OPINION", "ALLEGATION"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    who = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("S"), "l_suppkey"))
    proof = F.when(F.col("l_linenumber") == 6, F.array().cast("array<struct<source_article_id:string,quote:string>>")).otherwise(F.array(F.struct(F.col("l_suppkey").cast("string").alias("source_article_id"), F.lit("q").alias("quote"))))
    confidence = F.when(F.col("l_quantity") > 45, 101).otherwise(F.col("l_quantity").cast("int"))
    claim = F.struct(F.lit("c").alias("claim_text"), kind.alias("claim_type"), who.alias("attributed_to"), confidence.alias("confidence"), proof.alias("evidence"))
    tier = F.when(F.col("l_quantity") != 1, "standard")
    whole = F.to_json(F.struct(F.array(claim).alias("claims"), F.lit(False).alias("injection_detected"), tier.alias("risk_tier"), F.array().cast("array<string>").alias("risk_reasons")))
    raw = F.when(F.col("l_linenumber") == 7, F.left(whole, F.lit(20))).otherwise(whole)
    rows = t.lineitem.select(F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), raw.alias("answer"))
    return answers.checked(rows).select("story_id", "line", "part", "problem")


@query("""WITH c AS (SELECT story_id, list(place ORDER BY place) AS places FROM (SELECT l_orderkey AS story_id, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS place FROM lineitem) WHERE l_quantity > 20 GROUP BY 1)
SELECT story_id, CAST(places[1] AS BIGINT) AS a, CAST(places[story_id % 4 + 1] AS BIGINT) AS b FROM c WHERE story_id % 4 < len(places)""")
def pair_translation(t: Tables):
    """A pair for each story: its first checkable claim with the one at place story_id mod 4, which may not be there."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = t.lineitem.withColumn("place", (F.row_number().over(w) - 1).cast("bigint")).where("l_quantity > 20")
    checkable = rows.groupBy(F.col("l_orderkey").alias("story_id")).agg(F.array_sort(F.collect_list("place")).alias("places"))
    pairs = checkable.select("story_id", F.lit(0).cast("bigint").alias("a"), (F.col("story_id") % 4).alias("b"), F.lit("r").alias("reason"))
    return answers.translated(pairs, checkable).drop("reason")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'anthropic' ELSE 'ollama' END AS provider, CASE WHEN s_nationkey % 5 = 0 THEN 'GB' ELSE 'US' END AS country, CAST(length(left(repeat(s_name, 300), 2000)) AS BIGINT) AS kept FROM supplier""")
def provider_names(t: Tables):
    """The provider that a model's name tells, the country of a domain, and what is kept of a long error."""
    model = F.when(F.col("s_suppkey") % 3 == 0, "claude-x").otherwise("other:7b")
    host = F.when(F.col("s_nationkey") % 5 == 0, "theguardian.com").otherwise("example.org")
    kept = F.length(F.left(F.repeat("s_name", 300), F.lit(text.MOST_ERROR))).cast("bigint")
    return t.supplier.select(F.col("s_suppkey").alias("id"), text.model_provider(model).alias("provider"), text.country(host).alias("country"), kept.alias("kept"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'same_event' WHEN 2 THEN 'different' WHEN 3 THEN 'unsure' ELSE '' END AS verdict,
CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'correct,correct,correct' WHEN 2 THEN 'wrong,wrong,wrong' WHEN 3 THEN 'unsure,unsure,unsure' WHEN 4 THEN 'correct,wrong,wrong' ELSE '' END AS placements FROM orders""")
def verdict_grammar(t: Tables):
    """Typed answers about pairs and about stories of three placements, in turn."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % n + 1).cast("int"))
    pair, story = pick((" Quit", "Y", "no ", "?", "maybe", ""), 6), pick(("q", "yes", "N", "skip", "2, 3", "4", "x"), 7)
    return t.orders.select(F.col("o_orderkey").alias("id"), text.pair_verdict(pair).alias("verdict"), F.array_join(text.placement_verdicts(story, F.lit(3)), ",").alias("placements"))


@query("SELECT a.vec_id AS probe_id, b.vec_id AS row_id, round_even(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0 AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_distance(t: Tables):
    """Each vector's distance to the next one by id."""
    a, b = t.embeddings.select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("x")), t.embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("y"))
    return a.join(b, F.col("row_id") == F.col("probe_id") + 1).select("probe_id", "row_id", (F.bround(vectors.distance(F.col("x"), F.col("y")), 4) + F.lit(0.0)).alias("distance"))


@query("""SELECT event_id, CASE WHEN hour(l) % 12 = 0 THEN 12 ELSE hour(l) % 12 END || ':' || lpad(CAST(minute(l) AS VARCHAR), 2, '0') || CASE WHEN hour(l) < 12 THEN ' AM' ELSE ' PM' END || CASE WHEN s THEN ' EDT' ELSE ' EST' END AS shown, strftime(m, '%b %-d, %Y') AS day
FROM (SELECT event_id, s, m, m - CASE WHEN s THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS l FROM (SELECT event_id, m, m >= TIMESTAMP '2024-03-10 07:00:00' AND m < TIMESTAMP '2024-11-03 06:00:00' AS s FROM (SELECT event_id, ts + to_days(CAST(user_id % 12 * 30 AS INTEGER)) AS m FROM events)))""")
def eastern_time(t: Tables):
    """Event times, moved over a year, on the clock of New York."""
    m = F.timestamp_add("DAY", (F.col("user_id") % 12 * 30).cast("int"), F.col("ts")).cast("timestamp")
    return t.events.select("event_id", moments.eastern_time(m).alias("shown"), moments.short_date(m).alias("day"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_returnflag = 'A' AND l_quantity > 5 AS rating_shown, l_linestatus = 'O' AND l_quantity % 4 NOT IN (0, 1) AS safe FROM lineitem")
def rating_and_links(t: Tables):
    source = F.when(F.col("l_returnflag") == "A", "api").when(F.col("l_returnflag") == "R", "editor")
    health = F.element_at(F.array(*map(F.lit, ("broken", "expired", "ok", "unknown"))), (F.col("l_quantity") % 4 + 1).cast("int"))
    rating = F.when(F.col("l_quantity") > 5, F.col("l_quantity"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        serving.renderable_rating(rating, source).alias("rating_shown"), serving.link_safe(F.col("l_linestatus") == "O", health).alias("safe"),
    )


@query("SELECT c_custkey AS id, c_mktsegment AS kind FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING min(c_nationkey) = 0)")
def commercial_excluded(t: Tables):
    """Segments that a customer of nation 0 is in forbid commerce here; the others' customers stay."""
    kinds = t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg((F.min("c_nationkey") == 0).alias("forbids_commercial"))
    return serving.without_commerce(t.customer, "c_mktsegment", serving.forbidding(kinds)).select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))


@query("SELECT o_orderkey AS id, s.c_name AS reader, s.c_mktsegment AS category FROM orders o JOIN (SELECT * FROM customer WHERE c_nationkey % 2 = 0) s ON s.c_custkey = o.o_custkey")
def derived_self_join(t: Tables):
    """Articles with what a derived table says of their readers: one join, since Spark prunes the columns itself."""
    some = t.customer.where("c_nationkey % 2 = 0").select("c_custkey", F.col("c_name").alias("reader"), F.col("c_mktsegment").alias("category"))
    return t.orders.join(some, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), "reader", "category")


@query("""SELECT user_id AS provider, count(*) AS fetched, count(*) FILTER (WHERE value > 50) AS stored, count(*) FILTER (WHERE value <= 50 AND event_type <> 'error') AS duplicates, count(*) FILTER (WHERE value <= 50 AND event_type = 'error') AS skipped FROM events GROUP BY 1""")
def poll_run(t: Tables):
    low, bad = F.col("value") <= 50, F.col("event_type") == "error"
    return t.events.groupBy(F.col("user_id").alias("provider")).agg(F.count("*").alias("fetched"), F.count_if(~low).alias("stored"), F.count_if(low & ~bad).alias("duplicates"), F.count_if(low & bad).alias("skipped"))


@query(f"""SELECT provider, fails AS consecutive_failures, CASE WHEN fails < 5 THEN 'closed' WHEN epoch_us(TIMESTAMP '{d.NOW}') - epoch_us(opened) >= 2 * 86400000000 + 900000000 THEN 'half_open' ELSE 'open' END AS circuit_state FROM
(SELECT user_id AS provider, count(*) FILTER (WHERE bad) AS fails, max(ts) FILTER (WHERE bad) AS opened FROM
 (SELECT user_id, ts, last_ok IS NULL OR (ts, event_id) > last_ok AS after, event_type IN ('error', 'click', 'view') AND (last_ok IS NULL OR (ts, event_id) > last_ok) AS bad
  FROM (SELECT *, max((ts, event_id)) FILTER (WHERE event_type NOT IN ('error', 'click', 'view')) OVER (PARTITION BY user_id) AS last_ok FROM events)) GROUP BY 1)""")
def circuit_half_open(t: Tables):
    """Clicks and views count as failures too, so that some circuits are open; the clock is moved back two days."""
    ok = ~F.col("event_type").isin("error", "click", "view")
    polls = t.events.select(F.col("user_id").alias("provider"), F.col("ts").alias("at"), ok.alias("ok"), "event_id")
    return queues.circuit(polls, d.now() - F.expr("INTERVAL 2 DAYS"), "event_id").select("provider", "consecutive_failures", "circuit_state")

"""Operators on small literal tables, and folds against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.operators import claims, clustering, dedup, graph, guard, queues, scoring, serving, tables
from tidewire.sources import feeds


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_cascade_order(spark):
    rows = [(1, "u1", "c1", 7), (2, "u1", "c2", 8), (3, "u3", "c1", 9), (4, "u4", "c4", 0b1000000000111), (5, "u5", "c5", 0b1000000000110), (6, "u6", "c6", 0), (7, "u7", "c7", 0), (8, "u8", "c8", -1)]
    got = dedup.classify(spark.createDataFrame(rows, "id bigint, url_hash string, content_hash string, simhash bigint"))
    assert ids(got, "id", "dedup_status", "duplicate_of") == [
        (1, "unique", None), (2, "exact_duplicate", 1), (3, "exact_duplicate", 1), (4, "near_duplicate", 1), (5, "near_duplicate", 4), (6, "unique", None), (7, "unique", None), (8, "unique", None),
    ]


def test_near_pairs_lose_none(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(6)]
    signed = sorted({v - 2**64 if v >> 63 else v for v in values})
    got = ids(dedup.near_pairs(spark.createDataFrame([(v,) for v in signed], "simhash bigint")), "a", "b")
    assert got == sorted((a, b) for a in signed for b in signed if a != b and 0 < bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    for scheme in ((5, 2), (6, 3)):
        assert ids(dedup.near_pairs(spark.createDataFrame([(v,) for v in signed], "simhash bigint"), scheme=scheme), "a", "b") == got


def test_aliases_and_overexposure(spark):
    ents = spark.createDataFrame([(1, "A B C", "P"), (2, "b c", "P"), (3, "C", "P"), (4, "Ian", "P"), (5, "Iran", "P"), (6, "B  C", "P"), (7, "C", "O")], "entity_id bigint, name string, entity_type string")
    assert dict(ids(guard.alias_groups(ents), "entity_id", "group_id")) == {1: 2, 2: 3, 3: 3, 4: 4, 5: 5, 6: 3, 7: 7}
    edges = spark.createDataFrame([(a, e) for e, n in ((1, 2), (2, 3), (3, 4), (4, 6)) for a in range(n)], "article_id bigint, entity_id bigint")
    over = guard.overexposed(edges, ents, edges, 0.001, 5)
    assert ids(over, "entity_id", "exposure") == [(2, 7), (3, 7), (4, 6)]


def test_masthead_lifts_with_a_second_outlet(spark):
    ents = spark.createDataFrame([(1, "NPR", "ORG"), (2, "Iran", "PLACE"), (3, "x", "OTHER")], "entity_id bigint, name string, entity_type string")
    edges = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "story_id bigint, entity_id bigint")
    none = spark.createDataFrame([], "entity_id bigint")
    one = spark.createDataFrame([(9, "www.npr.org"), (9, "www.npr.org")], "story_id bigint, domain string")
    assert ids(guard.story_guard(edges, ents, none, one), "entity_id") == [(2,)]
    two = one.unionByName(spark.createDataFrame([(9, "bbc.co.uk")], one.schema))
    assert ids(guard.story_guard(edges, ents, none, two), "entity_id") == [(1,), (2,)]
    art = guard.article_guard(edges.withColumnRenamed("story_id", "article_id"), ents, none, one.withColumnRenamed("story_id", "article_id"))
    assert ids(art, "entity_id") == [(2,)]


def tilted(seed, tilt=0.0, dim=32):
    v = [0.0] * dim
    v[seed % dim], v[(seed + 1) % dim] = 1.0, tilt
    return v


def run_cluster(spark, arts, edges, threshold):
    start = datetime(2024, 1, 1)
    a = spark.createDataFrame([(i, start + timedelta(hours=n), d, v) for n, (i, d, v) in enumerate(arts)], "article_id bigint, published_at timestamp, domain string, vector array<double>")
    names = {e for _, e in edges}
    e = spark.createDataFrame(edges, "article_id bigint, entity_id bigint")
    ents = spark.createDataFrame([(n, f"name{n}", "PLACE") for n in names], "entity_id bigint, name string, entity_type string")
    out = clustering.cluster(a, e, ents, spark.createDataFrame([], "entity_id bigint"), threshold)
    return {r.article_id: (r.story_id, r.joined) for r in out.collect()}


def test_join_or_create(spark):
    assert run_cluster(spark, [(1, "a.com", tilted(0)), (2, "b.com", tilted(0))], [(1, 10), (2, 11)], 0.5) == {1: (1, False), 2: (2, False)}
    assert run_cluster(spark, [(1, "a.com", tilted(0)), (2, "b.com", tilted(0, 0.05))], [(1, 10), (2, 10)], 0.5) == {1: (1, False), 2: (1, True)}
    assert run_cluster(spark, [(1, "a.com", tilted(0)), (2, "b.com", tilted(5))], [(1, 10), (2, 10)], 0.82) == {1: (1, False), 2: (2, False)}
    middle = [(x + y) / 2 for x, y in zip(tilted(0), tilted(8), strict=True)]
    assert run_cluster(spark, [(1, "a.com", tilted(0)), (2, "b.com", tilted(8)), (3, "c.com", middle)], [(1, 10), (2, 11), (3, 10), (3, 11)], 0.5)[3] == (3, False)


def test_cluster_matches_one_fold(spark):
    """Folding components apart gives the same stories as one loop over all articles."""
    rng = np.random.default_rng(3)
    n = 60
    vecs = [np.where(np.arange(8) == rng.integers(4), 1.0, 0.0) + rng.normal(0, 0.15, 8) for _ in range(n)]
    ents = [set(rng.choice(12, rng.integers(0, 3), replace=False).tolist()) for _ in range(n)]
    stories, want = [], {}
    for i in range(n):
        sims = sorted(((-clustering._cos(vecs[i], s["sum"] / s["n"]), k) for k, s in enumerate(stories)))
        match = [(k, -sim) for sim, k in sims if -sim >= 0.8 and ents[i] & stories[k]["e"]]
        far = any(clustering._cos(stories[a]["sum"], stories[b]["sum"]) < 0.8 for a, _ in match for b, _ in match)
        if match and not far:
            s = stories[match[0][0]]
            s["sum"], s["n"], s["e"] = s["sum"] + vecs[i], s["n"] + 1, s["e"] | ents[i]
            want[i] = (s["id"], True)
        else:
            stories.append({"id": i, "sum": vecs[i], "n": 1, "e": set(ents[i])})
            want[i] = (i, False)
    got = run_cluster_many(spark, [(i, f"h{i}.net", vecs[i].tolist()) for i in range(n)], [(i, e) for i in range(n) for e in ents[i]])
    assert got == want


def run_cluster_many(spark, arts, edges):
    start = datetime(2024, 1, 1)
    a = spark.createDataFrame([(i, start + timedelta(minutes=i), d, v) for i, d, v in arts], "article_id bigint, published_at timestamp, domain string, vector array<double>")
    e = spark.createDataFrame(edges, "article_id bigint, entity_id bigint")
    ents = e.select("entity_id").distinct().select("entity_id", F.concat(F.lit("n"), "entity_id").alias("name"), F.lit("ORG").alias("entity_type"))
    out = clustering.cluster(a, e, ents, spark.createDataFrame([], "entity_id bigint"), 0.8, 1000)
    return {r.article_id: (r.story_id, r.joined) for r in out.collect()}


def test_consolidate_and_rejoin(spark):
    st = spark.createDataFrame([(1, 1, tilted(0)), (2, 2, tilted(0, 0.1)), (3, 3, tilted(0, 0.12)), (4, 4, tilted(9))], "story_id bigint, at bigint, vector array<double>")
    g = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7)], "story_id bigint, entity_id bigint")
    merges = clustering.consolidate(st, g, 0.9)
    assert ids(merges, "survivor_id", "absorbed_id") == [(1, 2), (1, 3)]
    assert ids(clustering.consolidate(st, g, 0.9, most=1), "absorbed_id") == [(2,)]
    members = spark.createDataFrame([(1, 10), (2, 20), (4, 40)], "story_id bigint, article_id bigint")
    assert ids(clustering.apply_merges(members, merges), "story_id", "article_id") == [(1, 10), (1, 20), (4, 40)]
    v = st.select("story_id", "vector")
    best = clustering.straggler_best(v.where("story_id = 1"), v.where("story_id in (2, 3)"), g.where("story_id = 1"), g.where("story_id in (2, 3)"), 0.5)
    assert ids(best, "story_id", "larger_id") == [(1, 2)]


def test_roots_of_long_chains(spark):
    f = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "story_id bigint, merged_into_id bigint")
    assert ids(clustering.resolve_merged(f), "story_id", "root") == [(i, 0) for i in range(300)]


def test_merges_have_no_cap(spark):
    n = 60
    st = spark.createDataFrame([(i, i, [1.0, 0.0]) for i in range(2 * n)], "story_id bigint, at bigint, vector array<double>")
    g = spark.createDataFrame([(i, i // 2) for i in range(2 * n)], "story_id bigint, entity_id bigint")
    want = [(2 * i, 2 * i + 1) for i in range(n)]
    assert ids(clustering.consolidate(st, g), "survivor_id", "absorbed_id") == want
    ents = g.select("entity_id").distinct().select("entity_id", F.concat(F.lit("n"), "entity_id").alias("name"), F.lit("ORG").alias("entity_type"))
    members = st.select("story_id", F.explode(F.when(F.col("story_id") % 2 == 0, F.array(F.lit("a.com"), F.lit("b.com"))).otherwise(F.array(F.lit("a.com")))).alias("domain"))
    assert ids(clustering.rejoin(st, members, g, ents, ents.where("false").select("entity_id")), "survivor_id", "absorbed_id") == want

    def left(state, merges):
        return state.join(merges.select(F.col("absorbed_id").alias("story_id")), "story_id", "left_anti")

    assert ids(clustering.every_pass(lambda s: clustering.consolidate(s, g, most=25), left, st), "survivor_id", "absorbed_id") == want


def test_rejoin_sees_what_was_absorbed(spark):
    """Story 2 shares entity 8 with the larger story only after story 1 has brought it."""
    st = spark.createDataFrame([(9, 0, tilted(0)), (1, 1, tilted(0, 0.1)), (2, 2, tilted(0, 0.2)), (3, 3, tilted(5)), (4, 4, tilted(0))], "story_id bigint, at bigint, vector array<double>")
    mem = spark.createDataFrame([(9, "a.com"), (9, "b.com"), (1, "c.com"), (2, "d.com"), (3, "d.com"), (4, "masthead.com")], "story_id bigint, domain string")
    edges = spark.createDataFrame([(9, 7), (1, 7), (1, 8), (2, 8), (3, 7), (4, 6), (9, 6)], "story_id bigint, entity_id bigint")
    ents = spark.createDataFrame([(7, "seven", "ORG"), (8, "eight", "ORG"), (6, "Masthead", "ORG")], "entity_id bigint, name string, entity_type string")
    none = ents.where("false").select("entity_id")
    got = clustering.rejoin(st, mem, edges, ents, none, 0.5)
    assert ids(got, "survivor_id", "absorbed_id", "shared_entities") == [(9, 1, 1), (9, 2, 1)]
    assert ids(clustering.rejoin(st, mem, edges, ents, none, 0.5, most=1), "absorbed_id") == [(1,)]


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = dict(ids(graph.components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "component"))
    assert got == {n: find(n) for n in up}


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, False, "h")], "single_source"), ([(1, False, "h"), (2, False, "g")], "corroborated"), ([(1, False, "h"), (2, False, "h")], "single_source"),
        ([(1, False, "h"), (1, False, "g")], "single_source"), ([(1, True, None)], "authoritative"), ([(1, False, None), (2, False, None)], "single_source"),
    ],
)
def test_verification(spark, rows, want):
    ev = spark.createDataFrame([(5, *r) for r in rows], "claim_id bigint, source_id bigint, is_authority boolean, content_hash string")
    cl = spark.createDataFrame([(5, "unverified"), (6, "unverified"), (7, "disputed")], "claim_id bigint, verification_status string")
    assert ids(claims.verify(cl, ev), "claim_id", "verification_status") == [(5, want), (6, "unverified"), (7, "disputed")]


def test_contradictions(spark):
    cl = spark.createDataFrame([(1, "authoritative"), (2, "single_source"), (3, "corroborated"), (4, "unverified")], "claim_id bigint, verification_status string")
    pairs = spark.createDataFrame([(1, 2, 3, "x"), (2, 2, 1, "y"), (3, 99, 1, "bad")], "ord bigint, a bigint, b bigint, reason string")
    shown = lambda df: [(r.claim_id, r.verification_status, [tuple(e) for e in r.contradicted_by]) for r in df.orderBy("claim_id").collect()]
    assert shown(claims.contradictions(cl, pairs)) == [(1, "authoritative", []), (2, "refuted", [(3, "x"), (1, "y")]), (3, "disputed", [(2, "x")]), (4, "unverified", [])]
    had = cl.withColumn("had", F.when(F.col("claim_id") == 2, F.array(F.struct(F.lit(7).cast("bigint").alias("claim_id"), F.lit("old").alias("reason")))))
    assert shown(claims.contradictions(had, pairs, "had"))[1] == (2, "refuted", [(7, "old"), (3, "x"), (1, "y")])


def test_scores(spark):
    ents = spark.createDataFrame([(1, "Texas", "PLACE"), (1, "Texas", "ORG"), (2, "x", "OTHER"), (3, "Texas", "PLACE")], "story_id bigint, name string, entity_type string")
    mem = spark.createDataFrame([(1, "US"), (2, "US"), (4, "GB")], "story_id bigint, country string")
    got = ids(scoring.relevance(ents, mem, scoring.is_us(F.col("name")), "US"), "story_id", "score")
    assert got == [(1, 70), (2, 40), (3, 60), (4, 0)]


def test_queues(spark):
    polls = spark.createDataFrame([("a", i, i > 5) for i in range(7)] + [("b", i, i < 2) for i in range(7)], "provider string, at int, ok boolean")
    assert ids(queues.circuit(polls), "provider", "consecutive_failures", "circuit_state") == [("a", 0, "closed"), ("b", 5, "open")]
    backlog = spark.createDataFrame([(i, "" if i == 1 else "t") for i in range(9)], "id bigint, text string")
    got = queues.dispatch(backlog, backlog.where("id = 2").select("id"), ["id"], 6, 3)
    assert [(r.batch, r.n, r.ids) for r in got.orderBy("batch").collect()] == [(0, 2, [0, 3]), (1, 2, [4, 5])]
    assert got.orderBy("batch").first().payload == '{"items":[{"id":"0","text":"t"},{"id":"3","text":"t"}]}'
    at = lambda i: datetime(2024, 1, 1) + timedelta(minutes=i)
    timed = spark.createDataFrame([("a", at(i), False, i) for i in range(5)] + [("b", at(3), i != 4, i) for i in range(5)] + [("c", at(1), False, 1)], "provider string, at timestamp, ok boolean, n int")
    for minutes, state in ((18, "open"), (19, "half_open")):
        assert ids(queues.circuit(timed, F.lit(at(minutes)), "n"), "provider", "consecutive_failures", "circuit_state") == [("a", 5, state), ("b", 1, "closed"), ("c", 1, "closed")]
    jobs = spark.createDataFrame([(1, "leased", "w", at(0)), (2, "leased", "v", at(0)), (3, "done", "w", at(0))], "job_id bigint, status string, worker string, lease_expires_at timestamp")
    beats = spark.createDataFrame([(1, "w"), (2, "w"), (3, "w")], "job_id bigint, worker string")
    assert ids(queues.extend(jobs, beats, F.lit(at(5))), "job_id", "lease_expires_at") == [(1, at(20)), (2, at(0)), (3, at(0))]
    assert ids(queues.complete(queues.complete(jobs, beats.where("job_id <> 2")), beats.where("job_id <> 2")), "job_id", "status") == [(1, "done"), (2, "leased"), (3, "done")]
    assert ids(timed.where(queues.circuit_allows(F.lit("open"), F.col("at"), F.lit(at(16)))).select("provider", "n"), "provider", "n") == [("a", 0), ("a", 1), ("c", 1)]


def test_pages_and_tables(spark, tmp_path):
    assert serving.PageRequest(0, 51).errors() == ["page must be from 1 to 500", "size must be from 1 to 50"]
    assert serving.PageRequest(0, 999).clamped() == serving.PageRequest(1, 100)
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    assert ids(tables.upsert(base, spark.createDataFrame([(2, "c"), (3, "d")], base.schema), ["id"]), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert ids(tables.update_from(base, spark.createDataFrame([(1, None), (2, "z")], base.schema), "id", ["v"]), "id", "v") == [(1, "a"), (2, "z")]
    new = tables.with_new_ids(base, spark.createDataFrame([("b",), ("x",), ("w",)], "v string"), ["v"], "id")
    assert sorted(r.id for r in new.collect()) == [1, 2, 3, 4]
    assert [r.n for r in tables.numbered(spark.range(50).select((F.lit(99) - F.col("id")).alias("k")), [F.col("k")], "n").orderBy("k").collect()] == list(range(1, 51))
    snap = tables.Snapshots(spark, f"file://{tmp_path}/t")
    assert snap.read() is None and snap.write(base) == 1 and snap.write(base.limit(1), "b7") == 2 and snap.read().count() == 1 and snap.tag() == "b7"
    assert snap.write(base, append=True) == 3 and snap.read().count() == 3
    one, two = tables.Snapshots(spark, f"file://{tmp_path}/t"), tables.Snapshots(spark, f"file://{tmp_path}/t")
    two._versions = lambda found=two._versions(): found  # it has not seen what the other commits meanwhile
    assert one.write(base) == 4
    with pytest.raises(Exception, match="exists"):
        two.write(base.limit(0))
    assert one.read().count() == 2
    few = tables.Snapshots(spark, f"file://{tmp_path}/t", most_folders=2)
    for _ in range(6):
        few.write(base, append=True)
    assert few.read().count() == 14 and len(few._versions()) == 3 and len(few._names("rows")) <= 6


RSS = """<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>T</title>
<item><title>One &amp; two</title><link>https://x.org/a?utm_source=f</link><description>&lt;p&gt;Short&lt;/p&gt;</description><content:encoded>&lt;p&gt;Whole &lt;span hidden&gt;act as a fool&lt;/span&gt;text&lt;/p&gt;</content:encoded><pubDate>Mon, 01 Jan 2024 10:00:00 +0200</pubDate><enclosure url="https://x.org/i.png" type="image/png"/></item>
<item><title>Two</title><guid>https://x.org/b</guid><author>me</author></item><item><title>None</title><guid isPermaLink="false">7</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link rel="self" href="https://y.org/self"/><link rel="alternate" href="https://y.org/e"/><published>2024-01-02T03:04:05Z</published><author><name>Ann</name></author><summary>S</summary></entry></feed>"""


def test_feeds(spark):
    docs = spark.createDataFrame([("rss", RSS), ("atom", ATOM), ("bad", "<rss><item>"), ("dtd", "<!DOCTYPE x []><rss/>"), ("big", "x" * (feeds.MOST_BYTES + 1))], "feed string, body string")
    got = {(r.feed, r["at"]): r for r in feeds.read("rss", docs, "2024-02-01 00:00:00").collect()}
    one = got["rss", 0]
    assert (one.canonical_url, one.title, one.body_text, str(one.published_at), one.timestamp_estimated) == ("https://x.org/a", "One & two", "Whole text", "2024-01-01 08:00:00", False)
    assert one.image_urls == ["https://x.org/i.png"] and one.hidden_blocks == 1 and one.patterns == []
    two = got["rss", 1]
    assert two.canonical_url == "https://x.org/b" and two.timestamp_estimated and two.authors == ["me"]
    assert got["rss", 2].skip_reason == "no link" and got["atom", 0].canonical_url == "https://y.org/e" and got["atom", 0].authors == ["Ann"]
    assert [got[f, -1].skip_reason for f in ("bad", "dtd", "big")] == ["malformed document", "document type refused", "document too large"]
    assert len([r for r in feeds.entries(spark.createDataFrame([("many", "<rss>" + "<item><title>t</title></item>" * 300 + "</rss>")], docs.schema)).collect()]) == 200
    with pytest.raises(ValueError):
        feeds.read("other", docs, "2024-02-01")


def test_folds_hold_the_last_hours_only(spark, sf):
    """Rows come in any batches; rejoin folds apart what can't meet, though entities chain all rows."""
    from tidewire import plans
    from tidewire.plans import vectors as v
    from tidewire.plans.registry import Tables

    start = datetime(2024, 1, 1)
    rows = [(0, i, start + timedelta(hours=h), "a.com", [1.0, 0.0], [], [5], ["n"]) for i, h in enumerate((0, 40, 80, 140))] + [(9, 9, start, "a.com", [1.0, 0.0], [], [5], ["n"])]
    frame = pd.DataFrame(rows, columns=["component", "article_id", "published_at", "domain", "vector", "labels", "entities", "names"])
    got = pd.concat(clustering._fold(0.5, 10)(iter([frame[i : i + 1] for i in range(len(frame))])))
    assert got.story_id.tolist() == [0, 0, 0, 3, 9]
    t = Tables(spark, sf)
    usable, st = v._entities(t, "story_id"), v._stories(t)
    outlets = st.select("story_id", F.when(F.col("story_id") % 3 == 0, 1).otherwise(2).alias("articles"))
    parts = clustering._rejoin_parts(st, usable, outlets, 0.2)
    assert parts.groupBy("component").count().agg(F.max("count")).first()[0] < st.count() / 10
    assert plans.QUERIES["rejoin_fold"](spark, sf).count() > 0


def test_whole_answers_only(spark):
    from tidewire.operators import answers

    good = '{"claims":[{"claim_text":"t","claim_type":"FACT","attributed_to":null,"confidence":5,"evidence":[{"source_article_id":"1","quote":"q"}]}],"injection_detected":false,"risk_tier":"high","risk_reasons":[]}'
    cases = {good: None, good.replace("FACT", "CLAIM"): "attributed_to", good.replace(":5,", ":101,"): "confidence", good.replace(":5,", ":5.5,"): "confidence", good.replace('"high"', '"mild"'): "risk_tier", good[:50]: "malformed", "[]": "malformed", "no": "malformed", '{"risk_tier":"high"}': "claims", good.replace('"quote":"q"', '"quote":null'): "evidence", good.replace("FACT", "GOSSIP"): "claim_type"}
    got = {r.answer: r.problem for r in answers.checked(spark.createDataFrame([(c,) for c in cases], "answer string")).collect()}
    assert got == cases


def test_stores(spark):
    from tidewire.operators import stores

    arts = spark.createDataFrame([(i, None, None) for i in range(4)], "article_id bigint, embedding array<double>, embedded_at timestamp")
    sent = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 9, [0.0, 1.0]), (2, 1, [1.0, 0.0]), (2, 2, [3.0, 0.0]), (3, 0, [0.0, 1.0])], "batch int, article_id bigint, vector array<double>")
    out = stores.store_vectors(arts, sent, 2, F.lit("2024-01-01").cast("timestamp"))
    assert ids(out, "article_id", "embedding") == [(0, [0.0, 1.0]), (1, None), (2, None), (3, None)] and ids(stores.unknown_ids(sent, arts), "article_id") == [(9,)]
    st = spark.createDataFrame([(1, "standard", False), (2, "high", True), (3, "standard", False)], "story_id bigint, risk_tier string, claims_extracted boolean")
    old = spark.createDataFrame([(1, 0, "old", "FACT", 1, 1, None), (2, 0, "old", "FACT", 1, 1, None)], "story_id bigint, ord int, claim_text string, claim_type string, confidence int, supporting_source_count bigint, first_asserted_at int")
    ev = spark.createDataFrame([], "story_id bigint, ord int, article_id bigint, source_id bigint, url string, quote string, stance string")
    runs = spark.createDataFrame([], "story_id bigint, provider string, status string, error string")
    items = spark.createDataFrame(
        [(1, None, "elevated", [("a", "FACT", 9, [(10, "q" * 5000), (11, "r"), (99, "x")]), ("b", "FACT", 9, [(99, "x")])]), (2, "e" * 5000, None, []), (7, None, "high", [])],
        "story_id bigint, error string, risk_tier string, claims array<struct<claim_text:string,claim_type:string,confidence:int,evidence:array<struct<article_id:bigint,quote:string>>>>",
    )
    articles = spark.createDataFrame([(10, 1, "u", 5), (11, 1, "v", 3)], "article_id bigint, source_id bigint, url string, published_at int")
    got = stores.store_claims(stores.ClaimStore(st, old, ev, runs), items, articles, "claude-9")
    assert ids(got.stories, "story_id", "risk_tier", "claims_extracted") == [(1, "elevated", True), (2, "high", True), (3, "standard", False)]
    assert ids(got.claims, "story_id", "claim_text", "supporting_source_count") == [(1, "a", 1), (2, "old", 1)] and got.claims.where("story_id = 1").first().first_asserted_at == 3
    assert sorted((r.article_id, len(r.quote)) for r in got.evidence.collect()) == [(10, 4000), (11, 1)]
    assert [(r.story_id, r.provider, r.status, len(r.error or "")) for r in got.runs.orderBy("story_id").collect()] == [(1, "anthropic", "ok", 0), (2, "anthropic", "invalid_output", 4000)]


def test_newest_before_matches_pairs(spark, monkeypatch):
    from tidewire.operators import dedup as dd

    rng = random.Random(2)
    monkeypatch.setattr(dd, "STEP", 16)
    rows = [(i, f"u{rng.randrange(400)}", f"c{rng.randrange(400)}", rng.choice([5, 5, 5, 7, 0xFF0, 0, 1 << 40])) for i in range(300)]
    got = {r.id: (r.dedup_status, r.duplicate_of) for r in dd.classify(spark.createDataFrame(rows, "id bigint, url_hash string, content_hash string, simhash bigint")).collect()}
    want = {}
    for i, u, c, h in rows:
        same = [j for j, x, _, _ in rows if j < i and x == u] or [j for j, _, x, _ in rows if j < i and x == c]
        near = [j for j, _, _, x in rows if j < i and x and h and bin(x ^ h).count("1") <= 3]
        want[i] = ("exact_duplicate", min(same)) if same else ("near_duplicate", max(near)) if near else ("unique", None)
    assert got == want
    old, new = rows[:250], rows[250:]
    schema = "id bigint, url_hash string, content_hash string, simhash bigint"
    got = {r.id: (r.dedup_status, r.duplicate_of) for r in dd.classify_new(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()}
    assert got == {i: want[i] for i, *_ in new}


def test_cluster_cuts_components_at_gaps(spark):
    """One entity over years: pieces parted by days are folded apart, with the decisions of one fold; top-k counts hardly differ."""
    rng = np.random.default_rng(5)
    at = [datetime(2024, 1, 1) + timedelta(hours=int(h)) for h in np.cumsum(rng.choice([1, 5, 30, 200], 120, p=[0.5, 0.3, 0.1, 0.1]))]
    vecs = [np.where(np.arange(8) == rng.integers(3), 1.0, 0.0) + rng.normal(0, 0.12, 8) for _ in at]
    ents = [set(rng.choice(6, rng.integers(1, 3), replace=False).tolist()) for _ in at]
    rows = spark.createDataFrame([(i, t, f"h{i}.net", v.tolist()) for i, (t, v) in enumerate(zip(at, vecs, strict=True))], "article_id bigint, published_at timestamp, domain string, vector array<double>")
    edges = spark.createDataFrame([(i, e) for i in range(len(at)) for e in ents[i]], "article_id bigint, entity_id bigint")
    names = edges.select("entity_id").distinct().select("entity_id", F.concat(F.lit("n"), "entity_id").alias("name"), F.lit("ORG").alias("entity_type"))
    dated = edges.join(rows.select("article_id", "published_at"), "article_id")
    from tidewire.operators.graph import components

    sizes = [r["count"] for r in components(clustering._meetings(dated)).groupBy("component").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 60
    for k, most in ((1000, 0), (10, 0.05)):
        stories, want = [], {}
        for i, (t, v) in enumerate(zip(at, vecs, strict=True)):
            live = [s for s in stories if t - s["last"] <= timedelta(hours=48)]
            sims = sorted(((-clustering._cos(v, s["sum"] / s["n"]), n) for n, s in enumerate(live)))[:k]
            match = [(live[n], -sim) for sim, n in sims if -sim >= 0.8 and ents[i] & live[n]["e"]]
            far = any(clustering._cos(a["sum"], b["sum"]) < 0.8 for a, _ in match for b, _ in match)
            if match and not far:
                s = match[0][0]
                s["sum"], s["n"], s["e"], s["last"] = s["sum"] + v, s["n"] + 1, s["e"] | ents[i], t
                want[i] = s["id"]
            else:
                stories.append({"id": i, "sum": v, "n": 1, "e": set(ents[i]), "last": t})
                want[i] = i
        got = {r.article_id: r.story_id for r in clustering.cluster(rows, edges, names, spark.createDataFrame([], "entity_id bigint"), 0.8, k).collect()}
        assert sum(got[i] != w for i, w in want.items()) <= most * len(want)


def test_model_slot_retries(spark):
    calls = []

    def fails_once(texts):
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("busy")
        return [[(t.upper(),)] for t in texts]

    import pandas as pd

    out = list(clustering.model_slot(fails_once, "name string", retries=1)(iter([pd.DataFrame({"id": [1, 2], "text": ["a", "b"]})])))
    assert out[0].values.tolist() == [[1, "A"], [2, "B"]] and len(calls) == 2
    named = spark.createDataFrame([(1, "x y")], "id bigint, text string").mapInPandas(clustering.model_slot(lambda texts: [[(w,) for w in t.split()] for t in texts], "name string"), "id bigint, name string")
    assert ids(named, "id", "name") == [(1, "x"), (1, "y")]


def test_files_that_are_too_large_leave_a_row(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text("x" * (feeds.MOST_BYTES + 1))
    items, cursor = feeds.fetch(spark, f"file://{tmp_path}", "2024-02-01 00:00:00")
    assert sorted(r.skip_reason or "" for r in items.collect()) == ["", "", "document too large", "no link"] and cursor
    later, same = feeds.fetch(spark, f"file://{tmp_path}", "2024-02-01 00:00:00", cursor="2999-01-01T00:00:00")
    assert later.count() == 0 and same == "2999-01-01T00:00:00"
    old, _ = feeds.fetch(spark, f"file://{tmp_path}", "2024-02-01 00:00:00", since="2024-01-15 00:00:00")
    assert "older than the window" in {r.skip_reason for r in old.collect()}


def test_dates_of_feeds(spark):
    cases = {"Mon, 01 Jan 2024 10:00:00 +0200": "2024-01-01 08:00:00", "1 Feb 2024 10:00:00 GMT": "2024-02-01 10:00:00", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T03:04:05.5+01:00": "2024-01-02 02:04:05.500000", "Tue, 2 Jan 24 03:04 EST": "2024-01-02 08:04:00", "2024-01-02": "2024-01-02 00:00:00", "soon": None, None: None}
    got = {r.d: r.t and str(r.t) for r in spark.createDataFrame([(c,) for c in cases], "d string").select("d", feeds.parsed_date(F.col("d")).alias("t")).collect()}
    assert got == cases


def test_registered_functions(spark):
    from tidewire.functions import register

    assert "tw_feed_entries" in register.register(spark)
    body = RSS.replace("'", "\\'").replace("\n", " ")
    assert [tuple(r) for r in spark.sql(f"SELECT at, title, skipped FROM tw_feed_entries('{body}')").collect()][0] == (0, "One & two", None)
    assert spark.sql("SELECT tw_mean_vector(v) AS m FROM VALUES (array(1.0D, 3.0D)), (array(3.0D, 5.0D)) AS t(v)").first().m == [2.0, 4.0]
    assert spark.sql("SELECT tw_mask_keys('{\"b\":1,\"a\":[{\"b\":2}]}', 'b') AS j").first().j == '{"a":[{"b":"*"}],"b":"*"}'
    assert spark.sql("SELECT tw_mask_keys('no', 'b') AS j").first().j is None


def test_shared_shuffles_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    side = lambda n, k: [(rng.choice([None, *range(n)]), rng.choice([None, *range(40)])) for _ in range(k)]
    a, b = side(60, 300) + [(99, e) for e in range(40)], side(20, 120) + [(7, e) for e in range(0, 40, 3)]
    want = {}
    for i, e in a:
        for j, f in b:
            if e is not None and e == f:
                want[i, j] = want.get((i, j), 0) + 1
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, entity_id bigint")
    for most in (4, 64):  # most keys have more rows than 4
        monkeypatch.setattr(guard, "LISTED", most)
        out = guard.shared(frame(a, "x"), "x", frame(b, "y"), "y")
        assert {(r.x, r.y): r.shared for r in out.collect()} == want and out.count() == len(want)
    few = guard.shared(frame(a[-20:], "x"), "x", frame(b[-10:], "y"), "y")  # short lists only
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "Aggregate [_a" in plan and not any("_a" in line and "_b" in line for line in plan.splitlines() if "Aggregate [" in line)


def test_statuses_take_no_distinct_counts(spark):
    e = [(1, 5, False, "x"), (1, 6, False, "y"), (2, 5, False, "x"), (2, 6, False, "x"), (3, 5, False, "x"), (3, 5, None, "y"), (4, 5, True, None), (5, 5, False, None), (5, 6, False, "x"), (6, None, None, "y"), (6, 7, None, "z")]
    evidence = spark.createDataFrame(e, "claim_id bigint, source_id bigint, is_authority boolean, content_hash string")
    out = claims.verify(spark.range(8).select(F.col("id").alias("claim_id"), F.lit("unverified").alias("verification_status")), evidence)
    want = {r.claim_id: r.verification_status for r in claims.verification(evidence).collect()}
    assert {r.claim_id: r.verification_status for r in out.collect()} == {0: "unverified", 7: "unverified"} | want
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_contradictions_join_each_pair_once(spark):
    st = spark.createDataFrame([(1, "authoritative"), (2, "unverified"), (3, "unverified")], "claim_id bigint, verification_status string")
    pairs = spark.createDataFrame([(1, 1, 2, "r"), (2, 3, 2, "s"), (3, 3, 9, "t")], "ord bigint, a bigint, b bigint, reason string")
    out = claims.contradictions(st, pairs)
    got = {r.claim_id: (r.verification_status, [tuple(e) for e in r.contradicted_by]) for r in out.collect()}
    assert got == {1: ("authoritative", []), 2: ("refuted", [(1, "r"), (3, "s")]), 3: ("disputed", [(2, "s")])}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_claims_are_stored_in_parts_of_a_size(spark, monkeypatch):
    old = [(1, "a", "F"), (1, "a", "F"), (2, "b", "F"), (3, "c", None), (3, "c", None), (4, "d", "F"), (None, "n", "F")]
    new = [(2, "x", "F", 1), (2, "x", "F", 1), (2, "y", "F", 9), (4, "z", "F", 1), (5, "v", None, 1), (6, "w", "F", 9), (None, "m", "F", 1), (1, "q", "F", 9)]
    now, found = spark.createDataFrame(old, "story_id bigint, claim_text string, claim_type string"), spark.createDataFrame(new, "story_id bigint, claim_text string, claim_type string, article_id bigint")
    arts, failed = spark.createDataFrame([(1,), (1,), (2,)], "article_id bigint"), spark.createDataFrame([(4,), (7,)], "story_id bigint")
    monkeypatch.setattr(claims, "PART", 2)
    out = claims.store(now, found, arts, failed)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(2, "x", "F"), (3, "c", None), (3, "c", None), (4, "d", "F"), (5, "v", None), (None, "n", "F"), (None, "m", "F")], key=repr)
    assert out.rdd.getNumPartitions() == 8  # 15 rows, whatever the session's number is


def test_near_pairs_come_once_without_a_shuffle(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for x in base for _ in range(3)]
    for width, schemes in ((64, [(4, 1), (5, 2), (6, 3)]), (32, [(4, 1), (5, 2), (6, 3)])):
        h = {(x & (2**width - 1)) - (2**64 if width == 64 and x >> 63 else 0) for x in base + near} | {0}
        want = sorted((a, b) for a in h for b in h if a and b and a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
        df = spark.createDataFrame([(x,) for x in h], "simhash bigint")
        for scheme in schemes:
            out = dedup.near_pairs(df, width=width, scheme=scheme)
            assert sorted(map(tuple, out.collect())) == want
            assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_newest_near_item_is_found_in_eras(spark, monkeypatch):
    """Of 32 bits: an asker that finds one in its own era goes no further, so most pairs are never met; the rest look through longer eras."""
    rng = random.Random(3)
    base = [rng.getrandbits(32) for _ in range(12)]
    rows = [(7 * i - 500, rng.choice([0, rng.choice(base), rng.choice(base) ^ (1 << rng.randrange(32)), rng.getrandbits(32)])) for i in range(400)]
    met, inner = [], dedup._met_in
    monkeypatch.setattr(dedup, "_met_in", lambda *a: met.append(inner(*a)) or met[-1])
    items = spark.createDataFrame(rows, "id bigint, simhash bigint")
    got = {r.id: r.near for r in dedup.near_before(items.where("simhash <> 0"), items, 32, era=20).collect()}
    near = lambda x, y: x and y and bin(x ^ y).count("1") <= 3
    want = {i: max(j for j, y in rows if j < i and near(x, y)) for i, x in rows if any(j < i and near(x, y) for j, y in rows)}
    assert got == want and len(met) == 2
    whole = {(x, y) for _, x in rows for _, y in rows if x != y and near(x, y)}
    assert sum(m.count() for m in met) < 4 * len(whole)
    pairs = {tuple(r) for r in met[-1].select("a", "b").collect()}
    assert pairs < whole
    assert dedup.near_before(items.where("id > 99999"), items.where("id > 99999"), 32).count() == 0


def test_md5_fingerprints_vote_by_bits(spark):
    import hashlib

    from tidewire.functions import bits

    for width in (32, 64):
        h = [int(hashlib.md5(w.encode()).hexdigest()[: width // 4], 16) for w in ("ab", "c'd", "ab", "9")]
        v = sum(1 << b for b in range(width) if 2 * sum(x >> b & 1 for x in h) > 4)
        df = spark.range(1).select(bits.simhash_md5(F.lit("Ab c'D"), F.lit("ab -- 9"), width).alias("x"), bits.simhash_md5(F.lit(None), F.lit(" "), width).alias("y"))
        assert tuple(df.first()) == (v - 2**64 if v >> 63 else v, 0)


def test_schemes_lose_none_and_keep_keys_long(spark):
    rng = random.Random(4)
    for width, schemes in dedup.SCHEMES.items():
        base = [rng.getrandbits(width) for _ in range(30)]
        found = {x ^ sum(1 << b for b in rng.sample(range(width), n)) for x in base for n in (0, 1, 2, 3, 4)}
        h = {x - (2**64 if width == 64 and x >> 63 else 0) for x in found}
        want = sorted((a, b) for a in h for b in h if a and b and a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
        df = spark.createDataFrame([(x,) for x in h], "simhash bigint")
        for _, blocks, same in schemes:
            assert sorted(map(tuple, dedup.near_pairs(df, width=width, scheme=(blocks, same)).collect())) == want
    blocks, same = dedup._scheme(500_000, 64)
    assert 64 * same // blocks >= 25 and dedup._scheme(100, 64) == (4, 1)


def test_near_pairs_work_out_fingerprints_once(spark, sf, monkeypatch):
    """A filter on a fingerprint before the cut is pushed below it, so that its UDF runs twice for each text."""
    from tidewire.plans import text
    from tidewire.plans.registry import Tables

    inner, plans_seen = dedup.cut, []
    monkeypatch.setattr(dedup, "cut", lambda df: plans_seen.append(df._jdf.queryExecution().executedPlan().toString()) or inner(df))
    t = Tables(spark, sf)
    assert dedup.near_pairs(text._hashes_md5_64(t)).where("a = 0 OR b = 0").count() == 0
    assert sum(p.count("EvalPython") for p in plans_seen) == 1


def test_fingerprints_of_a_batch_vote_each_for_itself(spark, monkeypatch):
    """Texts of one batch, among them empty ones and ones longer than what is laid out at a time."""
    import hashlib
    import re

    from tidewire.functions import bits

    monkeypatch.setattr(bits, "AT_ONCE", 7)
    rng = random.Random(5)
    words = ["ab", "c'd", "'", "9", "é", "İx", "K", "-", "\n", "zebra", "ab,9"]
    texts = ["", " ", None, *(" ".join(rng.choice(words) for _ in range(n)) for n in (1, 0, 3, 6, 7, 8, 0, 40, 2, 300)), "--", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    found = {r.id: [*re.findall("[a-z0-9']+", r.low)] for r in df.select("id", F.lower(F.concat_ws(" ", F.coalesce("t", F.lit("")), F.left(F.coalesce("t", F.lit("")), F.lit(400)))).alias("low")).collect()}
    for f, digest, width in ((bits.simhash, lambda w: hashlib.blake2b(w, digest_size=8), 64), (lambda a, b: bits.simhash_md5(a, b, 64), hashlib.md5, 64), (bits.simhash_md5, hashlib.md5, 32)):
        for r in df.select("id", f(F.col("t"), F.col("t")).alias("h")).collect():
            h = [int.from_bytes(digest(w.encode()).digest()[: width // 8], "big") for w in found[r.id]]
            v = sum(1 << b for b in range(width) if 2 * sum(x >> b & 1 for x in h) > len(h))
            assert r.h == (v - 2**64 if width == 64 and v >> 63 else v)
    assert bits._voted([b"\xff" * 8, b"\0" * 8], np.array([0, 0, 1, 1]), np.array([3, 0, 1]), 64).tolist() == [-1, 0, 0]


def test_near_pairs_of_a_large_key_meet_in_tiles(spark, monkeypatch):
    """Half of all fingerprints share their last 40 bits, so the largest keys are dealt over blocks; no pair is lost or comes twice."""
    rng = random.Random(6)
    base = [rng.getrandbits(24) << 40 | 12345 for _ in range(60)] + [rng.getrandbits(64) for _ in range(60)]
    h = {x ^ sum(1 << b for b in rng.sample(range(64), n)) for x in base for n in (0, 1, 2, 3)} | {i << 40 | 12345 for i in range(100)}
    h = sorted(x - (2**64 if x >> 63 else 0) for x in h)
    want = sorted((a, b) for a in h for b in h if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    df = spark.createDataFrame([(x,) for x in h], "simhash bigint")
    tiled, inner = [], dedup._tiled
    monkeypatch.setattr(dedup, "_tiled", lambda *a: tiled.append(inner(*a)) or tiled[-1])
    for rows, sample, pairs in ((16, 1, 1 << 18), (16, 4, 50), (4096, 16, 7)):
        monkeypatch.setattr(dedup, "ROWS", rows), monkeypatch.setattr(dedup, "SAMPLE", sample), monkeypatch.setattr(dedup, "PAIRS", pairs)
        for scheme in ((4, 1), (5, 2), (6, 3)):
            assert sorted(map(tuple, dedup.near_pairs(df, scheme=scheme).collect())) == want
            largest = tiled[-1].groupBy("key").count().agg(F.max("count")).first()[0]
            assert largest < 80 if sample == 1 else largest > 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # a key's rows go on over many batches
    try:
        assert sorted(map(tuple, dedup.near_pairs(df).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fingerprints_of_texts_longer_than_a_piece(spark, monkeypatch):
    """A batch is split into words in pieces of texts; a text that is longer than a piece is one of its own."""
    from tidewire.functions import bits

    texts = ["", None, "ab cd", "x " * 50 + "y", "ab", "", "c " * 9, "ab cd ef gh"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)

    def prints():
        return [(r.id, r.h, r.w) for r in df.select("id", bits.simhash_md5(F.col("t"), F.col("t"), 64).alias("h"), bits.simhash_md5(F.lit(""), F.col("t"), 64, whole=True).alias("w")).orderBy("id").collect()]

    want = prints()
    for size in (1, 7, 30):
        monkeypatch.setattr(bits, "SPLIT", size)
        assert prints() == want
    assert [w for _, _, w in want] == [bits._voted([bits._md5(x) for x in (t or "").split()], np.arange(len((t or "").split())), np.array([len((t or "").split())]), 64)[0] for t in texts]


def test_cascade_of_32_bits_takes_few_jobs(spark, monkeypatch):
    """rounds over ever longer eras, each of many joins with plans and stages of their own, took the driver's memory."""
    monkeypatch.setattr(dedup, "ERA", 2)
    rng = random.Random(4)
    rows = [(i, f"u{i}", f"c{i}", rng.choice([0, rng.getrandbits(32), 7, 7 << 20])) for i in range(300)]
    items = spark.createDataFrame(rows, "id bigint, url_hash string, content_hash string, simhash bigint")
    stages = spark.sparkContext._jsc.sc().dagScheduler().nextStageId
    before = stages()
    got = {r.id: r.duplicate_of for r in dedup.classify(items, 32).collect()}
    assert stages() - before < 100
    near = lambda x, y: x and y and bin(x ^ y).count("1") <= 3
    assert got == {i: max((j for j, _, _, y in rows if j < i and near(x, y)), default=None) for i, _, _, x in rows}


def test_newest_near_item_far_back_in_a_large_key(spark, monkeypatch):
    """One key holds all rows; most have their answer near, some beyond the steps that are taken together, ids repeat, and some askers are no items."""
    rng = random.Random(9)
    monkeypatch.setattr(dedup, "STEPS", 3), monkeypatch.setattr(dedup, "LOOK", 2)
    rows = [(i - i % 3 // 2, rng.choice([1 << 31, (1 << 31) + 7, (1 << 31) + 0b1111000, 0b111111110000000 + (1 << 31)]) ^ rng.choice([0, 0, 1 << 20])) for i in range(200)]
    rows = [(9000, 1), *((i, x) for i, x in rows if i < 150 or x & 7 == 7)]
    asks = [r for r in rows if r[0] % 2] + [(500, (1 << 31) + 0b1111000), (500, (1 << 31) + 0b1110000), (501, 0), (None, 7)]
    items, asking = (spark.createDataFrame(x, "id bigint, simhash bigint") for x in (rows, asks))
    near = lambda x, y: x and y and bin(x ^ y).count("1") <= 3
    want = {}
    for i, x in asks:
        want[i] = max([want.get(i, -1), *(j for j, y in rows if i is not None and j < i and near(x, y))])
    want = {i: j for i, j in want.items() if j >= 0}
    for era in (None, 40, 5):
        assert {r.id: r.near for r in dedup.near_before(asking, items, 32, era=era).collect()} == want
    assert dedup.near_before(asking.select(F.col("id").cast("int"), "simhash"), items.select(F.col("id").cast("int"), "simhash"), 32).schema["near"].dataType.simpleString() == "int"


def test_shared_meets_in_parts_and_leaves_no_shuffle_files(spark, monkeypatch):
    """lists that are shuffled with each of their entities filled the disk; parts give the same pairs, and each part's files are gone when shared() returns."""
    import time

    rng = random.Random(8)
    side = lambda n, k: [(rng.choice([None, *range(n)]), rng.choice([None, *range(40)])) for _ in range(k)]
    a, b = side(60, 300) + [(99, e) for e in range(40)], side(20, 120) + [(7, e) for e in range(0, 40, 3)]
    want = {}
    for i, e in a:
        for j, f in b:
            if e is not None and e == f and i is not None and j is not None:
                want[i, j] = want.get((i, j), 0) + 1
    a, b = ([r for r in x if r[0] is not None] for x in (a, b))
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    names = lambda: {f for f in files().mkString(";").split(";") if "/shuffle_" in f}
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, entity_id bigint")
    for most, at_once in ((64, 200), (4, 200), (64, 5000)):
        monkeypatch.setattr(guard, "LISTED", most), monkeypatch.setattr(guard, "AT_ONCE", at_once, raising=False)
        before = names()
        out = guard.shared(frame(a, "x"), "x", frame(b, "y"), "y")
        for _ in range(50):  # they are removed in the background
            left = names() - before
            if not left:
                break
            time.sleep(0.2)
        assert not left
        assert {(r.x, r.y): r.shared for r in out.collect()} == want and out.count() == len(want)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

"""Every registered domain query against its SQL on the smallest tables."""

import hashlib
import math
import os

import duckdb
import pandas as pd
import pytest

from tidewire import plans


def rows(df, cols):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, float) and v == int(v) else round(v, 6) if isinstance(v, float) else v

    return sorted(map(repr, (tuple(map(one, r)) for r in df[cols].astype(object).itertuples(index=False))))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(name, spark, sf, duck):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), duck.sql(plans.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


#: Queries that SQL can't say, and what tests each instead.
PLAIN = {"simhash_blake2b", "html_text", "sanitize_flags", "dedup_cascade_64", "consolidate_fold", "rejoin_fold", "cluster_fold", "cluster_events", "knn_indexed", "gazetteer_mentions"}


def test_queries_without_sql_are_known():
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == PLAIN


def test_texts_match_plain_python(spark, sf):
    """Fingerprints, visible text and hostile text of whole tables, row by row without Spark."""
    import html
    import re
    import unicodedata

    from tidewire.functions import text

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.id: r.simhash for r in plans.QUERIES["simhash_blake2b"](spark, sf).collect()}
    flags = {r.id: r for r in plans.QUERIES["sanitize_flags"](spark, sf).collect()}
    for r in docs:
        body = r.text or ""
        words = re.findall(r"[a-z0-9']+", (body.split("\n")[0] + " " + body[:400]).lower())
        h = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in words]
        v = sum(1 << b for b in range(64) if sum(1 if x >> b & 1 else -1 for x in h) > 0)
        assert got[r.doc_id] == (v - 2**64 if v >> 63 else v)
        plain = unicodedata.normalize("NFKC", body)
        seen = [c for c in plain if not (0x200B <= ord(c) <= 0x200F or 0x202A <= ord(c) <= 0x202E or 0x2060 <= ord(c) <= 0x2064 or 0x2066 <= ord(c) <= 0x2069 or ord(c) == 0xFEFF)]
        letters = sum(c.isalpha() for c in seen)
        foreign = sum(ord(c) > 127 and unicodedata.category(c).startswith("L") for c in seen)
        share = round(foreign / letters, 3) if letters and foreign / letters > 0.3 else None
        hits = [name for name, p in text.INJECTION if re.search(p, "".join(seen), re.I)]
        f = flags[r.doc_id]
        assert (f.invisible_chars, f.non_ascii_letter_ratio, f.patterns) == (len(plain) - len(seen), share, ",".join(hits))
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in plans.QUERIES["html_text"](spark, sf).collect():
        page = re.sub(r"(?s)<(script|style|noscript|template|iframe|object)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", pages[r.page_id])
        plain = html.unescape(re.sub(r"<[^>]*>", "", page))
        assert r.hidden_blocks == 0 and "".join(r.text.split()) == "".join(plain.split()) and r.text == " ".join(r.text.split())


def test_folds_match_plain_loops(spark, sf):
    """consolidate_fold, rejoin_fold, cluster_fold and cluster_events against loops over all rows."""
    import numpy as np

    from tidewire.operators.clustering import _cos

    vec = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ents = {i: {i // 8, (i + 4) // 8 + 10**9} for i in vec}
    order = sorted(vec)
    pairs = [(a, b) for a in order for b in range(a + 1, a + 12) if b in vec and ents[a] & ents[b] and _cos(vec[a], vec[b]) >= 0.2]
    gone, want = set(), []
    for a, b in sorted(pairs):
        if a not in gone and b not in gone:
            gone.add(b)
            want.append((a, b))
    assert sorted((r.survivor_id, r.absorbed_id) for r in plans.QUERIES["consolidate_fold"](spark, sf).collect()) == sorted(want)
    now, want = {i: set(e) for i, e in ents.items()}, []
    for s in (i for i in order if i % 3 == 0):
        near = [(-_cos(vec[s], vec[t]), t) for t in order if t % 3 and ents[s] & now[t] and _cos(vec[s], vec[t]) >= 0.2]
        if near:
            t = min(near)[1]
            now[t] |= ents[s]
            want.append((t, s))
    assert sorted((r.survivor_id, r.absorbed_id) for r in plans.QUERIES["rejoin_fold"](spark, sf).collect()) == sorted(want)

    def fold(rows, entities, join, k):
        stories, out = [], {}
        for i, at, v in rows:
            live = [s for s in stories if (at - s["last"]).total_seconds() <= 48 * 3600]
            near = sorted((-_cos(v, s["sum"] / s["n"]), n) for n, s in enumerate(live))[:k]
            match = [live[n] for sim, n in near if -sim >= join and entities.get(i, set()) & live[n]["e"]]
            if match and not any(_cos(a["sum"], b["sum"]) < join for a in match for b in match):
                s = match[0]
                s["sum"], s["n"], s["e"], s["last"] = s["sum"] + v, s["n"] + 1, s["e"] | entities[i], at
                out[i] = s["id"]
            else:
                stories.append({"id": i, "sum": v, "n": 1, "e": set(entities.get(i, ())), "last": at})
                out[i] = i
        return out

    start = pd.Timestamp("2024-01-01")
    got = {r.article_id: r.story_id for r in plans.QUERIES["cluster_fold"](spark, sf).collect()}
    assert got == fold([(i, start + pd.Timedelta(minutes=i), vec[i]) for i in order], ents, 0.2, 10)
    got = {r.article_id: r.story_id for r in plans.QUERIES["cluster_events"](spark, sf).collect()}
    from tidewire.operators import guard
    from tidewire.plans import domain as d
    from tidewire.plans.registry import Tables

    t = Tables(spark, sf)
    over = {r.entity_id for r in guard.overexposed(d.edges(t), d.entities(t), d.edges(t).select("article_id"), 0.01, 5).collect()}
    kinds = {r.entity_id for r in d.entities(t).where("entity_type <> 'OTHER'").collect()}
    of = {}
    for r in d.edges(t).collect():
        if r.entity_id in kinds - over:
            of.setdefault(r.article_id, set()).add(r.entity_id)
    rows = sorted((pd.Timestamp(r.o_orderdate), r.o_orderkey) for r in t.orders.collect() if r.o_orderkey in vec)
    plain = fold([(i, at, vec[i]) for at, i in rows], of, 0.2, 10)
    assert set(got) == set(plain) and sum(got[i] != s for i, s in plain.items()) <= 0.01 * len(plain)


def test_entry_needs_no_subpackage(spark):
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_near_duplicates_are_found_at_64_bits(spark, tmp_path):
    """word146 and word3167 are within 3 bits in 32 bits of md5, 34 bits apart in the reference's 64."""
    base = " ".join(f"tok{i}" for i in range(60))
    texts = {1: "word146", 2: "word3167", 3: base, 4: base + " tok0 tok1", 5: "word146 "}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"http://a.org/{i}", "") for i in texts], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    from tidewire.functions import bits

    def words(t):  # the title is the first line
        return (t + " " + t[:400]).split()

    def md5_64(found):
        h = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in found]
        v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        return v - 2**64 if v >> 63 else v

    def close(prints):
        return sorted((a, b) for a in prints for b in prints if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3)

    assert sorted((r.a, r.b) for r in plans.QUERIES["near_dup_pairs_64"](spark, str(tmp_path)).collect()) == close({md5_64(words(t)) for t in texts.values()})
    p = {i: bits.fingerprint(words(t)) for i, t in texts.items()}
    assert close({p[1], p[2]}) == [] and len(close({p[3], p[4]})) == 2
    got = {r.id: (r.dedup_status, r.duplicate_of) for r in plans.QUERIES["dedup_cascade_64"](spark, str(tmp_path)).collect()}
    assert got == {1: ("unique", None), 2: ("unique", None), 3: ("unique", None), 4: ("near_duplicate", 3), 5: ("exact_duplicate", 1)}
    assert plans.QUERIES["dedup_cascade"](spark, str(tmp_path)).where("id = 2").first().dedup_status == "near_duplicate"
    assert plans.QUERIES["simhash_bands_64"](spark, str(tmp_path)).where("value > 255").count() > 0


def test_near_dup_pairs_takes_whole_texts(spark, tmp_path):
    """Texts of one beginning of over 400 characters, and different ends: by the beginning alone they have one fingerprint, so no pair."""
    head = "some title\n" + " ".join(f"tok{i}" for i in range(80))
    texts = {1: head, 2: head + " tok0 tok1", 3: head + "\n" + " ".join(f"other{i}" for i in range(400)), 4: head + " tok2", 5: None, 6: ""}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))

    def whole(t):
        h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in (t.split("\n")[0] + " " + t).split()]
        return sum(1 << b for b in range(32) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {whole(t or "") for t in texts.values()} - {0}
    want = sorted((a, b) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 3)
    got = plans.QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b) for r in got) == want and want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(plans.ORACLE_SQL["near_dup_pairs"]).fetchall()) == want


def test_shared_guard_takes_all_articles(spark):
    sf = "/root/testdata/sf0.01"  # on the smallest tables all entities are too common
    of, want = {}, {}
    for r in plans.QUERIES["story_guard"](spark, sf).collect():
        of.setdefault(r.entity_id, []).append(r.story_id)
    for r in plans.QUERIES["article_guard"](spark, sf).collect():
        for s in of.get(r.entity_id, ()):
            want[r.article_id, s] = want.get((r.article_id, s), 0) + 1
    got = {(r.article_id, r.story_id): r.shared for r in plans.QUERIES["shared_guard_all"](spark, sf).collect()}
    assert got == want and any(a % 100 for a, _ in got)

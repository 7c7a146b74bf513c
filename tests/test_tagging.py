"""Names in texts against a scan of all names at every word."""

import re
from collections import Counter

import numpy as np

from tidewire import plans
from tidewire.operators import tagging


def words(text):
    return re.findall(r"[a-z0-9']+", (text or "").lower())


def plain(text, names):
    """The longest name at each word, from left to right; names is a map from words to the smallest id."""
    w, out, at = words(text), [], 0
    most = max(map(len, names), default=0)
    while at < len(w):
        n = next((n for n in range(min(most, len(w) - at), 0, -1) if tuple(w[at : at + n]) in names), 0)
        if n:
            out.append((names[tuple(w[at : at + n])], at, n))
        at += n or 1
    return out


def by_words(names):
    out = {}
    for i, name in names:
        if name is not None and i is not None and (w := tuple(words(name))):
            out[w] = min(i, out.get(w, i))
    return out


def test_mentions_match_a_scan(spark):
    rng = np.random.default_rng(6)
    letters = ["a", "b", "c", "d", "e'f", "9"]
    names = [(i, " ".join(rng.choice(letters, rng.integers(1, 4)))) for i in range(1, 40)] + [(50, "A-B"), (51, "..."), (52, None), (None, "a"), (53, "NEW york")]
    texts = [(i, ", ".join(rng.choice(letters, rng.integers(0, 60)))) for i in range(60)] + [(70, None), (71, ""), (72, "In New-York, new york."), (None, "a b c"), (73, "a " * 20_000)]
    texts += [texts[3], texts[3], (3, "d d d a b")]
    docs = spark.createDataFrame(texts, "id bigint, text string").repartition(3)
    table = spark.createDataFrame(names, "entity_id bigint, name string")
    known = by_words(names)
    want = sorted((str(i), *m) for i, t in texts for m in plain(t, known))
    for most in (10**6, 5, 1):
        got = sorted((str(r.id), r.entity_id, r.start, r.words) for r in tagging.mentions(docs, table, most).collect())
        assert got == want
    assert sorted((str(r.id), r.entity_id, r.start, r.words) for r in tagging.mentions(docs, table, 10**6, 30).collect()) == want
    assert tagging.mentions(docs, table.limit(0)).count() == 0 and tagging.mentions(docs.limit(0), table).count() == 0


def test_gazetteer_query_matches_a_scan(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    parts = [(-r.p_partkey, r.p_name) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    known = by_words([(i, " ".join(words(t)[:2])) for i, t in docs if i % 2 == 0] + parts)
    want = Counter((i, e) for i, t in docs for e, _, _ in plain(t, known))
    got = {(r.id, r.entity_id): r.mention_count for r in plans.QUERIES["gazetteer_mentions"](spark, sf).collect()}
    assert got == dict(want) and len({i for i, _ in want}) > 50


def test_texts_reach_python_as_one_string(spark):
    docs = spark.createDataFrame([(1, "Red fish, blue fish"), (2, None), (3, "blue  RED fish")], "id bigint, text string")
    names = spark.createDataFrame([(7, "red fish"), (8, "Blue"), (9, "blue fish")], "entity_id bigint, name string")
    for most in (500_000, 1):  # broadcast, and by groups
        out = tagging.mentions(docs, names, most)
        assert sorted((r.id, r.entity_id, r.start, r.words) for r in out.collect()) == [(1, 7, 0, 2), (1, 9, 2, 2), (3, 7, 1, 2), (3, 8, 0, 1)]
        assert "array_join" in out._jdf.queryExecution().analyzed().toString().split("MapInPandas")[-1]


def test_groups_over_many_batches_and_slices(spark, monkeypatch):
    """a document's matches of all groups meet, also where a batch holds names and documents; few groups are dealt over slices."""
    rng = np.random.default_rng(7)
    letters = [f"w{i}" for i in range(12)]
    names = [(i, " ".join(rng.choice(letters, rng.integers(1, 4)))) for i in range(1, 80)]
    texts = [(i, " ".join(rng.choice(letters, rng.integers(0, 40)))) for i in range(120)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w3 w4 w5")]
    docs, table = spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame(names, "entity_id bigint, name string")
    known = by_words(names)
    want = sorted((str(i), *m) for i, t in texts for m in plain(t, known))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for cells in (128, 1, 5):
            monkeypatch.setattr(tagging, "CELLS", cells, raising=False)
            monkeypatch.setattr(tagging, "SENT", 3, raising=False)
            for most in (40, 7):
                assert sorted((str(r.id), r.entity_id, r.start, r.words) for r in tagging.mentions(docs, table, most).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

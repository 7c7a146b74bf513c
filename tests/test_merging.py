"""Merged and hashed forms against counts and loops."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

from tidewire.functions import vectors
from tidewire.operators import encoding, merging


def rows(tables):
    return [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.collect()), key=str) for t in tables]


def test_moved_tables_are_those_of_a_recount(spark):
    rng = np.random.default_rng(3)
    members = [(int(rng.integers(8)), a, f"h{rng.integers(4)}") for a in range(60)]
    m = spark.createDataFrame(members, "story_id bigint, article_id bigint, domain string")
    v = spark.createDataFrame([(a, rng.normal(size=3).tolist()) for a in range(50)], "article_id bigint, vector array<double>")
    e = spark.createDataFrame([(int(a), int(x), int(n)) for a, x, n in rng.integers(1, 9, (90, 3))], "article_id bigint, entity_id bigint, mention_count bigint")
    kept = merging.counted(m, v, e)
    merges = spark.createDataFrame([(0, 3), (0, 5), (2, 6), (1, 99)], "survivor_id bigint, absorbed_id bigint")
    to = {3: 0, 5: 0, 6: 2}
    after = spark.createDataFrame([(to.get(s, s), a, d) for s, a, d in members], m.schema)
    moved = merging.after_merges(kept, merges)
    assert rows(moved) == rows(merging.counted(after, v, e))
    seen = {r.story_id: r for r in merging.summary(moved).collect()}
    assert set(seen) == {s for s, *_ in after.collect()} and seen[0].outlets == len({d for s, _, d in after.collect() if s == 0})
    # What a removed article had counted is taken back.
    some = after.where("article_id % 7 = 0")
    left = merging.after_removal(moved, merging.counted(some, v, e))
    assert rows(left) == rows(merging.counted(after.where("article_id % 7 <> 0"), v, e))


def test_hashed_vectors_match_loops(spark):
    texts = ["One fish two fish", "red fish, BLUE fish", "", None, "a b c d e f g " * 40, "fish", "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    tokens = [re.findall(r"[a-z0-9']+", (t or "").lower()) for t in texts]
    number = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % encoding.FEATURES
    df = Counter(f for t in tokens for f in {number(w) for w in t})
    got = {r.id: r.vector for r in encoding.hashed_vectors(docs).collect()}
    for i, t in enumerate(tokens):
        want = np.zeros(encoding.PLACES)
        for w in t:
            f = number(w)
            want[f % encoding.PLACES] += (1 if f // encoding.PLACES % 2 else -1) * (math.log((1 + len(texts)) / (1 + df[f])) + 1)
        want /= np.linalg.norm(want) or 1
        assert np.allclose(got[i], want)
    unit = encoding.hashed_vectors(docs.where("length(text) > 3 AND id < 6")).withColumnRenamed("vector", "v").selectExpr("0 AS batch", "v")
    assert vectors.batch_valid(unit, "batch", "v", encoding.PLACES).first().accepted
    assert encoding.hashed_vectors(docs.limit(0)).count() == 0


def test_hashed_vectors_norms_are_worked_out_once(spark):
    docs = spark.createDataFrame([(1, "one fish"), (1, "two fish"), (None, "red"), (None, "red")], "id bigint, text string")
    out = encoding.hashed_vectors(docs)
    got = {r.id: r.vector for r in out.collect()}
    assert set(got) == {1, None} and all(math.isclose(sum(x * x for x in v), 1) for v in got.values())
    # A norm inside the lambda over places would make a row's work their square, as would pairs of places their shuffle.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("SQRT") == 1

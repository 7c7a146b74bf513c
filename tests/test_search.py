"""Searches in tiles and by an index, pairs that share entities, greedy rounds: against loops."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tidewire.operators import clustering, greedy, index, tiles, work
from tidewire.operators.folding import cosine


def frame(spark, vecs, name):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vecs], f"{name} bigint, vector array<double>")


def test_tiles_meet_every_row(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vecs = [(i, rng.integers(-2, 3, 4)) for i in range(150)] + [(200, np.zeros(4)), (201, [1.0, float("nan"), 0, 0]), (202, None), (203, [1.0, 2.0])]
    probes = vecs[::10] + [(200, np.zeros(4)), (202, None), (201, [1.0, float("nan"), 0, 0])]
    good = [(i, np.array(v, float)) for i, v in vecs[:151]]
    sims = {p: sorted((-cosine(np.array(v, float), w), i) for i, w in good if i != p) for p, v in [*probes[:15], (200, np.zeros(4))]}
    monkeypatch.setattr(tiles, "ROWS", 16)
    monkeypatch.setattr(tiles, "PROBES", 4)
    p, r = frame(spark, probes, "probe_id"), frame(spark, vecs, "row_id")
    got = {}
    for x in clustering.nearest(p, r, 7).collect():
        got.setdefault(x.probe_id, []).append((x.rank, x.row_id, round(x.similarity, 9)))
    # Ties go to the smaller id: similarities as floats may differ in the last place, so they are compared rounded.
    assert sorted(got) == sorted(sims) and all(len(v) == 7 for v in got.values())
    for i, found in got.items():
        assert [s for _, _, s in sorted(found)] == [round(-s, 9) for s, _ in sims[i][:7]]
    pairs = {(x.probe_id, x.row_id) for x in clustering.similar(p, r, 0.45).collect()}
    assert pairs == {(i, j) for i, found in sims.items() for s, j in found if -s >= 0.45}


def test_index_holds_every_row_and_finds_what_it_says(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    vecs = [(i, centres[i % 12] + rng.normal(0, 0.4, 16)) for i in range(900)] + [(1000 + i, np.ones(16)) for i in range(400)] + [(2000, None), (2001, [1.0])]
    rows, probes = frame(spark, vecs, "row_id"), frame(spark, vecs[:900:10], "probe_id")
    monkeypatch.setattr(index, "BLOCK", 100)  # the list of equal rows is several tasks
    with work.tables(spark) as table:
        ix = index.VectorIndex(rows, table, 30)
        assert sorted(r.id for r in ix.lists.select("id").collect()) == sorted(i for i, v in vecs[:1300])
        exact = {(r.probe_id, r.row_id) for r in clustering.nearest(probes, rows, 10).collect()}
        whole = {(r.probe_id, r.row_id) for r in ix.search(probes, 10).collect()}
        assert whole == exact  # all lists: nothing is lost
        measured = ix.calibrate(probes, 10, 0.95)
        found = {(r.probe_id, r.row_id) for r in ix.search(probes, 10).collect()}
        assert measured >= 0.95 and len(found & exact) == round(measured * len(exact))
        assert ix.near < 15
    assert index.indexed_nearest(probes, rows.limit(0), 3).count() == 0


def test_pairs_that_share_entities(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n, start = 120, datetime(2024, 1, 1)
    vecs = [rng.integers(-1, 2, 5).astype(float) for _ in range(n)]
    ents = [sorted({int(e) for e in rng.choice(9, rng.integers(0, 4))} | ({99} if i % 3 == 0 else set())) for i in range(n)]
    at = [start + timedelta(hours=int(rng.integers(20))) for _ in range(n)]
    st = spark.createDataFrame([(i, at[i], vecs[i].tolist()) for i in range(n)], "story_id bigint, at timestamp, vector array<double>")
    g = spark.createDataFrame([(i, e) for i in range(n) for e in ents[i] + ents[i][:1]], "story_id bigint, entity_id bigint")
    want = {}
    for i in range(n):
        for j in range(n):
            if (at[i], i) < (at[j], j) and (shared := set(ents[i]) & set(ents[j])) and cosine(vecs[i], vecs[j]) >= 0.6:
                want[i, j] = len(shared)
    for block in (1024, 7):
        monkeypatch.setattr(tiles, "SHARING", block)
        assert {(r.a, r.b): r.shared for r in clustering.pairs_by_entity(st, g, 0.6).collect()} == want
        ids = st.select("story_id", "vector")
        left, right = ids.where("story_id < 30"), ids.where("story_id >= 30")
        best = {}
        for i in range(30):
            found = [(-round(cosine(vecs[i], vecs[j]), 9), j) for j in range(30, n) if set(ents[i]) & set(ents[j]) and cosine(vecs[i], vecs[j]) >= 0.6]
            if found:
                best[i] = min(found)
        got = {r.story_id: (-round(r.similarity, 9), r.larger_id) for r in clustering.straggler_best(left, right, g.where("story_id < 30"), g.where("story_id >= 30"), 0.6).collect()}
        assert {i: s for i, (s, _) in got.items()} == {i: s for i, (s, _) in best.items()}


@pytest.mark.parametrize("few", [1 << 18, -1])
def test_greedy_rounds_absorb_like_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(greedy, "FEW", few)
    rng = np.random.default_rng(4)
    graphs = [{tuple(sorted((int(a), int(b)))) for a, b in rng.integers(0, n, (m, 2)) if a != b} for n, m in ((40, 60), (60, 300))]
    graphs += [{(i, i + 1) for i in range(200)}, {(0, i) for i in range(1, 50)}, set()]
    for edges in graphs:
        time = rng.integers(0, 5, 300)
        pairs = [(a, b) if (time[a], a) < (time[b], b) else (b, a) for a, b in edges]
        gone, want = set(), {}
        for a, b in sorted(pairs, key=lambda p: (time[p[0]], p[0], time[p[1]], p[1])):
            if a not in gone and b not in gone:
                gone.add(b)
                want[b] = a
        rows = [(a, b, int(time[a]), int(time[b])) for a, b in pairs]
        got = greedy.merges(spark.createDataFrame(rows, "a bigint, b bigint, at_a int, at_b int")).collect()
        assert {r.b: r.a for r in got} == want and len(got) == len(want)


def test_index_gives_each_probe_out_once_from_python(spark, tmp_path, monkeypatch):
    """However many lists a probe asks, its vector leaves Python once, in short batches; parts of the probes find what all find together."""
    rng = np.random.default_rng(8)
    rows, probes = frame(spark, enumerate(rng.normal(size=(900, 6))), "row_id"), frame(spark, enumerate(rng.normal(size=(60, 6))), "probe_id")
    with work.tables(spark) as table:
        ix = index.VectorIndex(rows, table, 20)
        whole = sorted(tuple(r) for r in ix.search(probes, 5, 9).select("probe_id", "row_id", "rank").collect())
        monkeypatch.setattr(index, "AT_ONCE", 16)
        out = list(ix._assign(9)(iter([pd.DataFrame({"id": range(100), "vector": list(rng.normal(size=(100, 6)))})])))
        assert [len(x) for x in out] == [16] * 6 + [4] and all(len(set(n)) == 9 for x in out for n in x["lists"])
        monkeypatch.setattr(index, "ASKS", 8)
        assert sorted(tuple(r) for r in ix.search(probes, 5, 9).select("probe_id", "row_id", "rank").collect()) == whole
        assert len(whole) == 300

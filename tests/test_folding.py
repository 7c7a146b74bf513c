"""Join-or-create in rounds against one loop over all articles."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.operators import folding, graph

EMPTY = np.zeros(0)


def articles(n, hours):
    """Articles of six topics; an entity or two each, now and then a masthead; some stories pause for days."""
    rng = np.random.default_rng(11)
    at, rows = datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(minutes=int(rng.choice([5, 20, 60 * hours], p=[0.6, 0.38, 0.02])))
        v = np.where(np.arange(8) == rng.integers(6), 1.0, 0.0) + rng.normal(0, 0.25, 8)
        entities = sorted(set(rng.choice(5, rng.integers(0, 3)).tolist()))
        domain = f"h{rng.integers(3)}.com"
        rows.append((i % 2, i, at, domain, v.tolist(), [f"n{rng.integers(5)}"], entities, [f"n{e}" for e in entities]))
    return rows


def one_loop(rows, join, k):
    """The decisions by a loop that keeps every story and looks at all of them."""
    stories, out = {}, {}
    for part, i, at, domain, vector, labels, entities, names in rows:
        v, mine = np.array(vector), dict(zip(entities, names, strict=True))
        live = [s for s in stories.setdefault(part, []) if at - s["last"] <= timedelta(hours=48)]
        near = sorted((-folding.cosine(v, s["sum"]), n) for n, s in enumerate(live))[:k]
        match = []
        for sim, n in near:
            s = live[n]
            lone = s["labels"] if len(s["domains"]) == 1 else set()
            shared = [e for e, name in mine.items() if name not in labels and e in s["e"] and s["e"][e] not in lone]
            if -sim >= join and shared:
                match.append((s, -sim, len(shared)))
        if match and not any(folding.cosine(a[0]["sum"], b[0]["sum"]) < join for a in match for b in match):
            s, sim, shared = match[0]
            s["sum"], s["last"] = s["sum"] + v, at
            s["domains"].add(domain)
            s["e"] |= mine
            out[i] = (s["id"], True, round(sim, 4), shared)
        else:
            stories[part].append({"id": i, "sum": v, "e": mine, "domains": {domain}, "labels": set(labels), "last": at})
            out[i] = (i, False, None, 0)
    return out


SCHEMA = "component bigint, article_id bigint, published_at timestamp, domain string, vector array<double>, labels array<string>, entities array<bigint>, names array<string>"


def decisions(df):
    return {r.article_id: (r.story_id, r.joined, r.similarity, r.shared_entities) for r in df.collect()}


@pytest.mark.parametrize(("size", "k"), [(1000, 3), (12, 3), (30, 1000)])
def test_rounds_decide_like_one_loop(spark, size, k):
    rows = articles(150, 30)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = one_loop(rows, 0.7, k)
    assert decisions(folding.fold_in_rounds(df, 0.7, k, size)) == want
    assert 20 < sum(joined for _, joined, *_ in want.values()) < 140
    slices = folding._sliced(df, size).groupBy("component", "slice").count().toPandas()
    assert slices.groupby("component").slice.max().max() == slices.slice.max() and (slices["count"] < size + 12).all()
    assert (size < 100) == (len(slices) > 2)


def test_tiles_part_stories_and_articles():
    """Stories dealt over blocks in any batches give each pair once."""
    rng = np.random.default_rng(1)
    at = pd.Timestamp("2024-01-01")
    rows = [(c, b, i, at, rng.normal(size=4), at - pd.Timedelta(hours=i)) for c in (1, 2) for b in (0, 1) for i in range(50 * b, 50 * b + 50)]
    rows += [(c, b, 1000 + i, at, rng.normal(size=4), pd.NaT) for c in (1, 2) for b in (0, 1) for i in range(5)]
    frame = pd.DataFrame(rows, columns=["component", "block", "id", "at", "vector", "last"]).sort_values(["component", "block"], kind="stable")
    for step in (1, 7, 1000):
        got = pd.concat(folding._tiles(0.5)(iter([frame[a : a + step] for a in range(0, len(frame), step)])))
        want = sorted(
            (a.id, s.id)
            for a in frame[frame["last"].isna()].itertuples()
            for s in frame[frame["last"].notna()].itertuples()
            if (a.component, a.block) == (s.component, s.block) and s.id <= 48 and folding.cosine(a.vector, s.vector) >= 0.5
        )
        assert sorted(zip(got.article_id, got.story_id, strict=True)) == want


def test_rounds_of_nothing(spark):
    assert folding.fold_in_rounds(spark.createDataFrame([], SCHEMA), 0.5, 10).count() == 0


def test_components_end_in_one_task_or_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    few = sorted(map(tuple, graph.components(df).collect()))
    monkeypatch.setattr(graph, "FEW", 20)  # rounds first
    assert sorted(map(tuple, graph.components(df).collect())) == few
    monkeypatch.setattr(graph, "FEW", -1)
    assert sorted(map(tuple, graph.components(df).collect())) == few
    assert dict(few)[455] == 400 and dict(few)[5] <= 5
    assert spark.range(1).select(F.lit(1).alias("a"), F.lit(1).alias("b")).transform(graph.components).count() == 1


def run_stream(spark, folder, checkpoint, out):
    from tidewire.streaming import stories

    stories.use_rocksdb(spark)
    source = spark.readStream.schema(SCHEMA.replace("component", "part")).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    q = stories.stories(source, 0.7, 3, "1 hour").writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out)


def test_stream_decides_like_the_rounds_and_goes_on_after_a_stop(spark, tmp_path):
    import os

    rows = articles(90, 30)
    want = one_loop(rows, 0.7, 3)
    end = rows[-1][2] + timedelta(hours=60)
    # Articles that only move time on, so that all stories end.
    rows += [(part, 1000 + part + 10 * n, end + timedelta(hours=60 * n), "z.com", [0.0] * 8, [], [], []) for n in range(2) for part in (0, 1)]
    frames = [rows[a : a + 31] for a in range(0, len(rows), 31)]
    folders = [tmp_path / "whole", tmp_path / "first"]

    def put(folder, n):
        spark.createDataFrame(frames[n], SCHEMA.replace("component", "part")).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        for f in folder.glob("*.parquet"):
            os.utime(f, (1000 + n, 1000 + n)) if f.stat().st_mtime > 10**6 else None

    for n in range(len(frames)):
        put(folders[0], n)
    whole = run_stream(spark, f"file://{folders[0]}", f"file://{tmp_path}/c0", f"file://{tmp_path}/o0")
    got = {r.article_id: (r.story_id, r.joined, r.similarity, r.shared_entities) for r in whole.where("open AND article_id < 1000").collect()}
    assert got == want
    closed = {r.story_id: r.articles for r in whole.where("NOT open AND story_id < 1000").collect()}
    sizes = pd.Series([s for s, *_ in want.values()]).value_counts().to_dict()
    assert closed == sizes and whole.where("NOT open AND story_id < 1000").count() == len(sizes)
    put(folders[1], 0)
    run_stream(spark, f"file://{folders[1]}", f"file://{tmp_path}/c1", f"file://{tmp_path}/o1")
    for n in range(1, len(frames)):
        put(folders[1], n)
    again = run_stream(spark, f"file://{folders[1]}", f"file://{tmp_path}/c1", f"file://{tmp_path}/o1")
    key = lambda r: (r["part"], r["article_id"] or -1, r["story_id"], str(r["similarity"]), r["last_activity"], r["open"])
    assert sorted(map(key, again.collect())) == sorted(map(key, whole.collect()))


@pytest.mark.parametrize("block", [4, 4096])
def test_slices_are_folded_side_by_side(spark, monkeypatch, block):
    """Far fewer rounds than slices; many open stories meet a slice in tiles, few in its own task."""
    rng = np.random.default_rng(5)
    at = datetime(2024, 1, 1)
    rows = [(1, i, at + timedelta(minutes=40 * i), f"h{i % 3}.com", rng.normal(size=8).tolist(), ["m"], [i // 4, (i + 2) // 4 + 1000], ["a", "b"]) for i in range(240)]
    rounds, fold = [], folding._slice_fold
    monkeypatch.setattr(folding, "_slice_fold", lambda *a: rounds.append(a) or fold(*a))
    monkeypatch.setattr(folding, "BLOCK", block)
    df = spark.createDataFrame(rows, SCHEMA)
    want = one_loop(rows, 0.3, 5)
    assert decisions(folding.fold_in_rounds(df, 0.3, 5, 10)) == want
    assert 10 < sum(joined for _, joined, *_ in want.values()) < 230
    slices = folding._sliced(df, 10).agg(F.max("slice")).first()[0]
    assert slices >= 20 and len(rounds) <= slices // 2

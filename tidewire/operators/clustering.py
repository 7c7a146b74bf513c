"""Stories: nearest candidates, join-or-create, consolidation, rejoining, resync."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import vectors

from . import folding, greedy, guard, tiles
from .folding import cosine as _cos
from .folding import one_stream as _fold
from .folding import WINDOW_HOURS
from .graph import components, cut

# Similarities, candidates, merges of one tick of a recurring job (for callers that want its cap).
JOIN, MERGE, CANDIDATES, MOST_MERGES = 0.82, 0.90, 10, 50


def similar(probes: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(probe_id, row_id, similarity) of a stated probe set against all rows, from `least` on.

    probes(probe_id, vector), rows(row_id, vector), met in tiles; a row is never compared with itself.
    """
    return tiles.met(probes, rows, least=least)


def nearest(probes: DataFrame, rows: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k most similar rows of each probe, ties to the smaller id: the k of each tile first, then the k of those."""
    return tiles.ranked(tiles.met(probes, rows, k), k)


def join_candidates(probes: DataFrame, rows: DataFrame, probe_guard: DataFrame, row_guard: DataFrame, threshold: float = JOIN, k: int = CANDIDATES) -> DataFrame:
    """Candidates that clear the top k, then the threshold, then the guard: in that order."""
    near = nearest(probes, rows, k).where(F.col("similarity") >= threshold)
    share = guard.shared(probe_guard.toDF("probe_id", "entity_id"), "probe_id", row_guard.toDF("row_id", "entity_id"), "row_id")
    return near.join(share, ["probe_id", "row_id"])


def digests(matches: DataFrame, rows: DataFrame, threshold: float = JOIN) -> DataFrame:
    """(probe_id): probes whose matches hold two rows less similar than the threshold. At most k matches each."""
    m = matches.join(rows, "row_id").select("probe_id", "row_id", "vector")
    a, b = m.toDF("probe_id", "ra", "va"), m.toDF("probe_id", "rb", "vb")
    return a.join(b, "probe_id").where("ra < rb").where(vectors.cosine(F.col("va"), F.col("vb")) < threshold).select("probe_id").distinct()


def cluster(articles: DataFrame, edges: DataFrame, entities: DataFrame, over: DataFrame, join: float = JOIN, k: int = CANDIDATES, size: int = folding.SLICE) -> DataFrame:
    """Each article's story: article_id, story_id (its founder's id), joined, similarity, shared_entities.

    articles(article_id, published_at, domain, vector). A join needs a shared guard entity
    that an article of the last WINDOW_HOURS has, directly or through others, so each entity's
    articles are cut where WINDOW_HOURS pass without one, and components over these pieces
    (before mastheads are left out) can't see each other. The top-k cut then counts stories of the
    own component only. Slices of about `size` articles of a component are folded side by side, in
    rounds (fold_in_rounds), so no task goes through a whole component, and a long one takes few rounds.
    """
    from tidewire.functions import text

    usable = cut(edges.join(entities.where("entity_type <> 'OTHER'"), "entity_id").join(over.select("entity_id"), "entity_id", "left_anti").select("article_id", "entity_id", "name"))
    part = components(_meetings(usable.join(articles.select("article_id", "published_at"), "article_id").select("article_id", "entity_id", "published_at")))
    lists = usable.groupBy("article_id").agg(F.collect_list(F.struct("entity_id", text.compact_name(F.col("name")).alias("name"))).alias("e"))
    rows = articles.join(part, F.col("article_id") == F.col("node"), "left").join(lists, "article_id", "left")
    empty = F.array().cast("array<struct<entity_id:bigint,name:string>>")
    rows = rows.select(
        "article_id", "published_at", "domain", "vector", F.coalesce("component", "article_id").alias("component"),
        F.coalesce(text.publisher_labels(F.col("domain")), F.array().cast("array<string>")).alias("labels"),
        F.transform(F.coalesce("e", empty), lambda x: x["entity_id"]).alias("entities"), F.transform(F.coalesce("e", empty), lambda x: x["name"]).alias("names"),
    )
    return folding.fold_in_rounds(rows, join, k, size)


def _meetings(dated: DataFrame) -> DataFrame:
    """Edges (a, b) that connect each entity's articles as far as no gap of more than WINDOW_HOURS parts them, from dated(article_id, entity_id, published_at).

    A story's entities last as long as it is active, which is WINDOW_HOURS behind its last
    article; that one shares some entity with the one before. So entities are cut by gaps in
    the time of all articles that entities connect: first the components without regard to
    time, then cuts at their gaps.
    """
    first = dated.groupBy("entity_id").agg(F.min("article_id").alias("b"))
    loose = components(dated.join(first, "entity_id").select(F.col("article_id").alias("a"), "b"))
    own = dated.select("article_id", "published_at").distinct().join(loose, F.col("article_id") == F.col("node")).select("article_id", "published_at", "component")
    # Days of a component that have articles: a row a day, so a window over them is short.
    day = F.floor(F.unix_seconds(F.col("published_at").cast("timestamp")) / 86400)
    days = own.select("component", day.alias("day")).distinct()
    w = Window.partitionBy("component").orderBy("day")
    far = F.col("day") - F.lag("day").over(w) > WINDOW_HOURS // 24 + 1
    eras = days.withColumn("era", F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    placed = own.withColumn("day", day).join(eras, ["component", "day"]).select("article_id", "era")
    rows = dated.select("article_id", "entity_id").join(placed, "article_id")
    head = rows.groupBy("entity_id", "era").agg(F.min("article_id").alias("b"))
    return rows.join(head, ["entity_id", "era"]).select(F.col("article_id").alias("a"), "b")


def pairs_by_entity(stories: DataFrame, story_guards: DataFrame, threshold: float = MERGE) -> DataFrame:
    """(a, b, similarity, shared) of stories (story_id, at, vector) that share a guard entity and are similar; a is older."""
    by_id = stories.select(F.col("story_id").alias("id"), "vector")
    found = tiles.sharing(by_id, story_guards.select(F.col("story_id").alias("id"), "entity_id"), threshold)
    at = stories.select("story_id", "at")
    found = found.join(at.toDF("x", "at_x"), "x").join(at.toDF("y", "at_y"), "y")
    first = (F.col("at_x") < F.col("at_y")) | ((F.col("at_x") == F.col("at_y")) & (F.col("x") < F.col("y")))
    older = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
    return found.select(older("x", "y").alias("a"), older("y", "x").alias("b"), older("at_x", "at_y").alias("at_a"), older("at_y", "at_x").alias("at_b"), "similarity", "shared")


def _first(merges: DataFrame, most: int | None, *order: str) -> DataFrame:
    merges = merges.orderBy(*order)
    return merges if most is None else merges.limit(most)


def every_pass(find, apply, state):
    """The merges of passes that are capped, until one finds none: `find(state)` gives a pass's merges, `apply(state, merges)` the next state."""
    out = None
    while not (merges := cut(find(state))).isEmpty():
        out, state = merges if out is None else out.unionByName(merges), apply(state, merges)
    return merges if out is None else out


def consolidate(stories: DataFrame, story_guards: DataFrame, threshold: float = MERGE, most: int | None = None) -> DataFrame:
    """Merges in the order of the older story; it survives, an absorbed story does nothing more.

    The greedy order is followed in rounds (greedy.merges). All merges are returned; with
    `most`, the first so many.
    """
    merges = greedy.merges(pairs_by_entity(stories, story_guards, threshold))
    merges = merges.select(F.col("a").alias("survivor_id"), F.col("b").alias("absorbed_id"), "at_a", "at_b", F.bround("similarity", 4).alias("similarity"), F.col("shared").alias("shared_entities"))
    return _first(merges, most, "at_a", "survivor_id", "at_b", "absorbed_id").select("survivor_id", "absorbed_id", "similarity", "shared_entities")


def straggler_best(singles: DataFrame, larger: DataFrame, single_guard: DataFrame, larger_guard: DataFrame, threshold: float = JOIN) -> DataFrame:
    """The most similar larger story of each single one, at the join threshold and with a shared guard entity."""
    ids = lambda df: df.toDF("id", *df.columns[1:])
    rows = tiles.sharing(ids(singles), ids(single_guard), threshold, ids(larger), ids(larger_guard)).withColumnsRenamed({"x": "story_id", "y": "larger_id"})
    w = Window.partitionBy("story_id").orderBy(F.desc("similarity"), "larger_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("story_id", "larger_id", "similarity", "shared")


def _rejoin_fold(threshold: float):
    """Single stories of one component, in order, each to the best larger one as it is by then, of those that it could meet."""

    def guard_set(story: dict) -> set:
        lone = story["labels"] if len(story["domains"]) == 1 else set()
        return {e for e, name in story["entities"].items() if name not in lone}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [
            {"id": r.story_id, "at": r.at, "v": np.asarray(r.vector, dtype=float), "n": r.articles, "domains": set(r.domains), "labels": set(r.labels), "entities": dict(zip(r.entities, r.names, strict=True))}
            for r in pdf.sort_values(["at", "story_id"]).itertuples()
        ]
        place, out = {s["id"]: n for n, s in enumerate(rows)}, []
        near = {r.story_id: r.near for r in pdf.itertuples()}
        for s in (s for s in rows if s["n"] == 1):
            mine, best = guard_set(s), None
            for t in (rows[n] for n in sorted(place[t] for t in near[s["id"]])) if mine and near[s["id"]] is not None else ():
                sim = _cos(s["v"], t["v"])
                if sim >= threshold and (best is None or sim > best[1]) and (share := mine & guard_set(t)):
                    best = (t, sim, len(share))
            if best:
                t, sim, n = best
                t["entities"] = s["entities"] | t["entities"]
                t["domains"] |= s["domains"]
                out.append((t["id"], s["id"], round(sim, 4), n, s["at"]))
        return pd.DataFrame(out, columns=["survivor_id", "absorbed_id", "similarity", "shared_entities", "at"])

    return run


def _rejoin_pairs(stories: DataFrame, usable: DataFrame, outlets: DataFrame, threshold: float) -> DataFrame:
    """(s, t) of single and larger stories that could meet in a rejoin, which is less than sharing entities.

    Similarities don't change in a pass, but a larger story's entities grow by those of what
    it may absorb, so pairs are added until none comes. Pairs meet in tiles, so only similar ones are sent.
    """
    ones = outlets.where("articles = 1").select("story_id")
    mine = cut(usable.join(ones, "story_id").select(F.col("story_id").alias("s"), "entity_id"))
    reach = cut(usable.join(outlets.where("articles > 1"), "story_id").select(F.col("story_id").alias("t"), "entity_id"))
    vector = stories.select(F.col("story_id").alias("id"), "vector")
    pairs, new = None, reach
    while True:
        met = tiles.sharing(vector, mine.toDF("id", "entity_id"), threshold - 1e-6, vector, new.toDF("id", "entity_id"))  # the fold decides
        met = met.select(F.col("x").alias("s"), F.col("y").alias("t"))
        met = cut(met if pairs is None else met.join(pairs, ["s", "t"], "left_anti"))
        if met.isEmpty():
            return met if pairs is None else pairs
        pairs = met if pairs is None else cut(pairs.unionByName(met))
        new = cut(met.join(mine, "s").select("t", "entity_id").distinct().join(reach, ["t", "entity_id"], "left_anti"))
        reach = cut(reach.unionByName(new))


def _rejoin_parts(stories: DataFrame, usable: DataFrame, outlets: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the stories that such pairs connect."""
    return components(_rejoin_pairs(stories, usable, outlets, threshold).toDF("a", "b"))


def rejoin(stories: DataFrame, members: DataFrame, story_edges: DataFrame, entities: DataFrame, over: DataFrame, threshold: float = JOIN, most: int | None = None) -> DataFrame:
    """Single stories reunited with the larger story they should have joined, which survives.

    stories(story_id, at, vector): vectors as the pass starts; members(story_id, domain).
    What a story absorbs changes its guard for later ones: its entities grow and its
    masthead counts once a second outlet is in. All this stays within a component over
    pairs that could meet, so components are folded apart, each in order of (at, id). All rejoins
    are returned; with `most`, the first so many.
    """
    from tidewire.functions import text

    usable = story_edges.select("story_id", "entity_id").distinct().join(entities.where("entity_type <> 'OTHER'"), "entity_id").join(over.select("entity_id"), "entity_id", "left_anti")
    lists = usable.groupBy("story_id").agg(F.collect_list(F.struct("entity_id", text.compact_name(F.col("name")).alias("name"))).alias("e"))
    outlets = members.groupBy("story_id").agg(F.count("*").alias("articles"), F.collect_set("domain").alias("domains"))
    pairs = _rejoin_pairs(stories, usable, outlets, threshold)
    near = pairs.groupBy(F.col("s").alias("story_id")).agg(F.collect_list("t").alias("near"))
    rows = stories.join(outlets, "story_id").join(lists, "story_id").join(components(pairs.toDF("a", "b")), F.col("story_id") == F.col("node")).join(near, "story_id", "left")
    labels = F.flatten(F.transform("domains", text.publisher_labels))
    rows = rows.select("component", "story_id", "at", "vector", "articles", "domains", "near", labels.alias("labels"), F.transform("e", lambda x: x["entity_id"]).alias("entities"), F.transform("e", lambda x: x["name"]).alias("names"))
    at = rows.schema["at"].dataType.simpleString()
    found = rows.groupBy("component").applyInPandas(_rejoin_fold(threshold), f"survivor_id bigint, absorbed_id bigint, similarity double, shared_entities int, at {at}")
    return _first(found, most, "at", "absorbed_id").select("survivor_id", "absorbed_id", "similarity", "shared_entities")


def apply_merges(members: DataFrame, merges: DataFrame) -> DataFrame:
    """members(story_id, ...) under their survivors; one pass absorbs no survivor's survivor."""
    m = merges.select(F.col("absorbed_id").alias("story_id"), F.col("survivor_id").alias("_to"))
    return members.join(m, "story_id", "left").withColumn("story_id", F.coalesce("_to", "story_id")).drop("_to")


def resync(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Story entities rebuilt from current members: mention counts are summed."""
    return members.select("story_id", "article_id").join(edges, "article_id").groupBy("story_id", "entity_id").agg(F.sum("mention_count").alias("mention_count"))


def resolve_merged(forest: DataFrame) -> DataFrame:
    """(story_id, root) of a parent forest (story_id, merged_into_id) by pointer doubling until no row moves."""
    at = cut(forest.select("story_id", F.coalesce("merged_into_id", "story_id").alias("root")))
    for _ in range(at.count().bit_length()):  # no chain is longer than the rows
        up = at.toDF("via", "above")
        step = cut(at.join(up, F.col("root") == F.col("via"), "left").select("story_id", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
        at = step.select("story_id", "root")
        if step.where("moved").isEmpty():
            break
    return at


def model_slot(model, columns: str, retries: int = 0):
    """A slot for a model over text batches: an iterator of pandas frames (id, text) in, rows of `columns` for each out.

    The library brings no models; `model` is the caller's own function from a list of texts to
    lists of rows, loaded once in each worker. Taggers, encoders and claim extraction fit in.
    A call that raises is made again `retries` times.
    """

    def call(texts: list[str]):
        for left in range(retries, -1, -1):
            try:
                return model(texts)
            except Exception:
                if not left:
                    raise

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in columns.split(",")]
        for pdf in batches:
            found = call(pdf["text"].tolist())
            yield pd.DataFrame([(i, *row) for i, rows in zip(pdf["id"], found, strict=True) for row in rows], columns=["id", *names])

    return run


def blocker(similarity: Column, shared: Column, threshold: float = JOIN) -> Column:
    """What kept a pair apart: threshold, guard, both, or something else."""
    low, none = similarity < threshold, shared == 0
    return F.when(low & none, "both").when(low, "threshold").when(none, "guard").otherwise("other")

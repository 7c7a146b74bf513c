"""Join-or-create over a stream of articles, as rounds over all slices of event time at once against a written table of stories."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import work

# Hours that a story takes articles after its last one.
WINDOW_HOURS = 48
#: Articles of a component from which on its slice ends, at the end of an hour; open stories that meet a slice in one task; rows of a product.
SLICE, BLOCK, AT_ONCE = 2048, 4096, 1024

DECISION = ["article_id", "story_id", "joined", "similarity", "shared_entities"]
STORY = ["founded", "n", "sums", "entities", "names", "domains", "labels", "last"]
#: What a slice gives out: its decisions, and the stories that it changed as they are at its end.
MADE = ["kind", "component", "slice", *DECISION, *STORY]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def _likest(sims: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of these places the k largest, and all that tie with the last one."""
    if len(at) <= k:
        return at
    some = sims[at]
    return at[some >= np.partition(some, len(some) - k)[len(some) - k]]


class Stories:
    """Stories that articles of this run changed or founded, their sums and norms in growing arrays, with the last activity of each."""

    def __init__(self):
        self.stories: list[dict] = []
        self.sums, self.norms, self.last = np.zeros((0, 0)), np.zeros(0), np.zeros(0, "datetime64[ns]")

    def add(self, story: dict, v: np.ndarray) -> None:
        n = len(self.stories)
        if n == len(self.sums):
            size = max(16, 2 * n)
            sums, norms, last = np.zeros((size, len(v))), np.zeros(size), np.zeros(size, "datetime64[ns]")
            if n:
                sums[:n], norms[:n], last[:n] = self.sums, self.norms, self.last
            self.sums, self.norms, self.last = sums, norms, last
        self.stories.append(story)
        self.put(n, v, story["last"])

    def put(self, i: int, v: np.ndarray, last: pd.Timestamp) -> None:
        self.sums[i], self.norms[i], self.last[i] = v, np.linalg.norm(v), np.datetime64(last)
        self.stories[i]["last"] = last

    def close(self, before: np.datetime64) -> None:
        """Forget stories without activity since a time, once they are most."""
        keep = np.flatnonzero(self.last[: len(self.stories)] >= before)
        if 2 * len(keep) < len(self.stories):
            for part in (self.sums, self.norms, self.last):
                part[: len(keep)] = part[keep]
            self.stories = [self.stories[i] for i in keep]

    def near(self, v: np.ndarray, join: float, before: np.datetime64, k: int) -> list[tuple[float, int]]:
        """(similarity, place) of the open ones that are similar enough: the k nearest, and ties."""
        n = len(self.stories)
        if not n:
            return []
        both = self.norms[:n] * np.linalg.norm(v)
        sims = np.where(both > 0, self.sums[:n] @ v / np.where(both > 0, both, 1), 0.0)
        return [(float(sims[i]), i) for i in _likest(sims, np.flatnonzero((sims >= join) & (self.last[:n] >= before)), k)]


class Fold:
    """Articles in order: each joins the nearest open story that shares a guard entity with it, or founds one.

    `stored` are stories as they were written before; an article brings its similarities to
    them along. A stored story that an article joins moves over to the changed ones, to which
    similarities are computed here.
    """

    def __init__(self, join: float, k: int, stored: dict[int, dict] | None = None, forget: bool = True):
        self.join, self.k, self.stored, self.changed, self.forget = join, k, stored or {}, Stories(), forget

    def place(self, a, near=()) -> tuple:
        """The decision on an article: id, published_at, domains (its one), vector, labels, entities, names."""
        v, before = np.asarray(a.vector, dtype=float), np.datetime64(a.published_at - pd.Timedelta(hours=WINDOW_HOURS))
        if self.forget:
            self.changed.close(before)
        own, entities = set(a.labels), dict(zip(a.entities, a.names, strict=True))
        mine = {e for e, name in entities.items() if name not in own}
        found = [(-sim, s["founded"], s["id"], s, i) for sim, i in self.changed.near(v, self.join, before, self.k) for s in [self.changed.stories[i]]]
        for x in near:
            s = self.stored.get(x["story_id"])
            if s and x["similarity"] >= self.join and np.datetime64(s["last"]) >= before:
                found.append((-x["similarity"], s["founded"], s["id"], s, None))
        match = []
        for sim, _, _, s, i in sorted(found, key=lambda f: f[:3])[: self.k]:
            lone = s["labels"] if len(s["domains"]) == 1 else set()
            if share := {e for e in mine & s["entities"].keys() if s["entities"][e] not in lone}:
                match.append((-sim, len(share), s, i))
        sums = [m[2]["sums"] if m[3] is None else self.changed.sums[m[3]] for m in match]
        if match and not any(cosine(x, y) < self.join for n, x in enumerate(sums) for y in sums[:n]):
            sim, share, s, i = match[0]
            s["n"] += 1
            s["domains"] |= set(a.domains)
            s["entities"] |= entities
            s["last"] = max(s["last"], a.published_at)
            if i is None:
                del self.stored[s["id"]]
                self.changed.add(s, s.pop("sums") + v)
            else:
                self.changed.put(i, self.changed.sums[i] + v, s["last"])
            return a.id, s["id"], True, round(sim, 4), share
        self.changed.add({"id": a.id, "founded": a.published_at, "n": 1, "entities": entities, "domains": set(a.domains), "labels": own, "last": a.published_at}, v)
        return a.id, a.id, False, None, 0


def one_stream(join: float, k: int):
    """The fold over rows in order of component and time, without rounds: for what one task may hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, component = Fold(join, k), None
        for pdf in batches:
            out = []
            for a in pdf.assign(domains=[[d] for d in pdf["domain"]]).rename(columns={"article_id": "id"}).itertuples():
                if component is None or a.component != component:
                    fold, component = Fold(join, k), a.component
                out.append(fold.place(a))
            yield pd.DataFrame(out, columns=DECISION).astype({"similarity": "float64"})

    return run


def _runs(batches: Iterator[pd.DataFrame], *key: str) -> Iterator[pd.DataFrame]:
    """The rows of each key of a stream that is sorted by it."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[list(key)].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
            if held and (n or (held[-1][list(key)].iloc[-1].to_numpy() != k[0]).any()):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _tiles(join: float, *key: str):
    """Similarities of a slice's articles to a block of the stories that were open before it, tile by tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in _runs(batches, *(key or ("component", "block"))):
            stories, arts = tile[tile["last"].notna()], tile[tile["last"].isna()]
            if not len(stories) or not len(arts):
                continue
            s, last, ids = np.stack(stories["vector"]), stories["last"].to_numpy("datetime64[ns]"), stories["id"].to_numpy()
            norms = np.linalg.norm(s, axis=1)
            for a in range(0, len(arts), AT_ONCE):
                some = arts.iloc[a : a + AT_ONCE]
                v = np.stack(some["vector"])
                both = np.linalg.norm(v, axis=1)[:, None] * norms
                sims = np.where(both > 0, v @ s.T / np.where(both > 0, both, 1), 0.0)
                before = some["at"].to_numpy("datetime64[ns]") - np.timedelta64(WINDOW_HOURS, "h")
                i, j = np.nonzero((sims >= join) & (last >= before[:, None]))
                yield pd.DataFrame({"article_id": some["id"].to_numpy()[i], "story_id": ids[j], "similarity": sims[i, j]})

    return run


class _Known:
    """The stories that were open before a slice, as one matrix; those that an article joins leave it."""

    def __init__(self, stored: dict[int, dict]):
        self.ids, self.place = np.array(list(stored)), {i: n for n, i in enumerate(stored)}
        self.sums = np.stack([s["sums"] for s in stored.values()])
        self.norms, self.here = np.linalg.norm(self.sums, axis=1), np.ones(len(stored), bool)
        self.last = np.array([np.datetime64(s["last"]) for s in stored.values()])

    def sims(self, vectors: np.ndarray) -> np.ndarray:
        both = np.linalg.norm(vectors, axis=1)[:, None] * self.norms
        return np.where(both > 0, vectors @ self.sums.T / np.where(both > 0, both, 1), 0.0)

    def near(self, sims: np.ndarray, join: float, before: np.datetime64, k: int) -> list[dict]:
        at = _likest(sims, np.flatnonzero((sims >= join) & self.here & (self.last >= before)), k)
        return [{"story_id": i, "similarity": x} for i, x in zip(self.ids[at].tolist(), sims[at].tolist(), strict=True)]


def _slice_fold(join: float, k: int):
    """Each slice: first the stories that were open before it, then its articles in order; decisions, then the stories that they changed.

    Where tiles found what an article is near, it brings that along; else the similarities are worked out here.
    """

    def changed(fold: Fold, key: tuple) -> Iterator[tuple]:
        for s, v in zip(fold.changed.stories, fold.changed.sums, strict=False):
            ids, names = list(s["entities"]), list(s["entities"].values())
            yield "story", *key, None, s["id"], None, None, None, s["founded"], s["n"], v.tolist(), ids, names, sorted(s["domains"]), sorted(s["labels"]), s["last"]

    def placed(fold: Fold, known: _Known | None, arts: pd.DataFrame) -> Iterator[tuple]:
        for n in range(0, len(arts), AT_ONCE):
            some = arts.iloc[n : n + AT_ONCE]
            sims = None if known is None else known.sims(np.stack(some["vector"]))
            for i, a in enumerate(some.itertuples()):
                near = a.near if a.near is not None else ()
                if not a.tiled and known is not None:
                    near = known.near(sims[i], join, np.datetime64(a.published_at - pd.Timedelta(hours=WINDOW_HOURS)), k)
                out = fold.place(a, near)
                if out[2] and known is not None and out[1] in known.place:
                    known.here[known.place[out[1]]] = False
                yield out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # forget=False: all stories that a slice changed are given out, also those that it ended.
        fold, key, known, nothing = Fold(join, k, forget=False), None, None, (None,) * len(STORY)
        for batch in batches:
            out: list[tuple] = []
            for pdf in _runs(iter([batch.rename(columns={"at": "published_at"})]), "component", "slice"):
                if (own := (int(pdf["component"].iloc[0]), int(pdf["slice"].iloc[0]))) != key:
                    out += changed(fold, key)
                    fold, key, known = Fold(join, k, forget=False), own, None
                old = pdf["last"].notna()
                for a in pdf[old].itertuples():
                    fold.stored[a.id] = {"id": a.id, "founded": a.published_at, "n": a.n, "sums": np.array(a.vector), "entities": dict(zip(a.entities, a.names, strict=True)), "domains": set(a.domains), "labels": set(a.labels), "last": a.last}
                arts = pdf[~old]
                if len(arts):
                    if known is None and fold.stored and not arts["tiled"].iloc[0]:
                        known = _Known(fold.stored)
                    out += [("decision", *key, *row, *nothing) for row in placed(fold, known, arts)]
            if out:
                yield pd.DataFrame(out, columns=MADE)
        if tail := list(changed(fold, key)):
            yield pd.DataFrame(tail, columns=MADE)

    return run


def _sliced(rows: DataFrame, size: int) -> DataFrame:
    """rows with `slice`: from 1 on in each component, whole hours, a new one once `size` articles are in. Counts of hours decide."""
    hour = F.floor(F.unix_seconds(F.col("published_at").cast("timestamp")) / 3600).alias("hour")
    per = rows.groupBy("component", hour).agg(F.count("*").alias("n"))  # a row for each hour that has articles
    w = Window.partitionBy("component").orderBy("hour")
    full = per.withColumn("full", F.floor(F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / size))
    number = F.dense_rank().over(Window.partitionBy("component").orderBy("full"))
    return rows.withColumn("hour", hour).join(full.select("component", "hour", number.alias("slice")), ["component", "hour"]).drop("hour")


def _reached(rows: DataFrame) -> DataFrame:
    """(component, slice, start, reach): where each slice starts, and the last slice that starts before the stories of this one close."""
    ends = rows.groupBy("component", "slice").agg(F.min("published_at").alias("start"), F.max("published_at").alias("end"))
    starts = ends.select("component", F.col("start").alias("t"), F.lit(0).alias("mark"), "slice", "start")
    closing = ends.select("component", (F.col("end") + F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")).alias("t"), F.lit(1).alias("mark"), "slice", F.lit(None).cast(rows.schema["published_at"].dataType).alias("start"))
    w = Window.partitionBy("component").orderBy("t", "mark").rowsBetween(Window.unboundedPreceding, 0)  # a row or two for each slice
    both = starts.unionByName(closing).withColumn("reach", F.max(F.when(F.col("mark") == 0, F.col("slice"))).over(w))
    return both.groupBy("component", "slice").agg(F.max("start").alias("start"), F.max(F.when(F.col("mark") == 1, F.col("reach"))).alias("reach"))


def _open_at(made: DataFrame, slices: DataFrame) -> DataFrame:
    """(component, slice, story_id, at, print): the stories open as slice `at` starts, each as the last slice before left it."""
    w = Window.partitionBy("component", "story_id").orderBy("slice")
    stories = made.where("kind = 'story'").select("component", "slice", "story_id", "last", F.xxhash64("story_id", "slice", *STORY).alias("print"))
    until = stories.withColumn("next", F.lead("slice").over(w)).join(slices.select("component", "slice", "reach"), ["component", "slice"])
    until = until.withColumn("to", F.least(F.coalesce("next", "reach"), "reach")).where("to > slice")
    at = until.select("component", "slice", "story_id", "last", "print", F.explode(F.sequence(F.col("slice") + 1, F.col("to"))).alias("at"))
    starts = slices.select("component", F.col("slice").alias("at"), "start")
    return at.join(starts, ["component", "at"]).where(F.col("last") >= F.col("start") - F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")).select("component", "slice", "story_id", "at", "print")


def fold_in_rounds(rows: DataFrame, join: float, k: int, size: int = SLICE) -> DataFrame:
    """Decisions (article_id, story_id, joined, similarity, shared_entities) on rows(component, article_id, published_at, domain, vector, labels, entities, names).

    A slice's decisions follow from the stories that are open as it starts. All slices of all
    components are folded side by side, each from the stories that the slices before it are thought
    to leave; at first, that every article founds one. In each further round those slices are folded again whose open
    stories differ from what they were folded from, until none does. A component's first slice is
    right after one round, and each next one once those before it are, so the end is what
    one loop over the component's articles decides; where it differs little from the first
    thought, most slices are right after two or three rounds. If only few slices come to stand in a
    round, the next ones take fewer slices from the first open one on, so the work stays in proportion.

    A slice has about `size` articles (more only if one hour of a component has more) and is folded in
    one task. Up to BLOCK open stories meet it there; more meet its articles in tiles of BLOCK stories before.
    """
    spark = rows.sparkSession
    at = rows.schema["published_at"].dataType.simpleString()
    story = f"founded {at}, n bigint, sums array<double>, entities array<bigint>, names array<string>, domains array<string>, labels array<string>, last {at}"
    schema = f"kind string, component bigint, slice int, article_id bigint, story_id bigint, joined boolean, similarity double, shared_entities int, {story}"
    null = lambda kind: F.lit(None).cast(kind)
    article = ["component", "slice", F.col("article_id").alias("id"), F.col("published_at").alias("at"), F.array("domain").alias("domains"), "vector", "labels", "entities", "names", null(at).alias("last"), F.lit(1).cast("bigint").alias("n")]
    stored = ["component", F.col("at").alias("slice"), F.col("story_id").alias("id"), F.col("founded").alias("at"), "domains", F.col("sums").alias("vector"), "labels", "entities", "names", "last", "n"]
    near = null("array<struct<story_id:bigint,similarity:double>>").alias("near")
    slot = ["component", "slice"]
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with work.tables(spark) as table, ExitStack() as held:
        rows = rows.withColumns({"component": F.col("component").cast("bigint"), "vector": F.transform("vector", lambda x: x.cast("double"))})
        rows = table(_sliced(table(rows), size).repartition(*slot))
        slices = table(_reached(rows).coalesce(1))
        first = {"kind": F.lit("story"), "story_id": F.col("article_id"), "founded": F.col("published_at"), "n": F.lit(1).cast("bigint"), "sums": F.col("vector"), "domains": F.array("domain"), "last": F.col("published_at")}
        first |= {c: null(kind) for c, kind in [("joined", "boolean"), ("similarity", "double"), ("shared_entities", "int")]}
        made, used = rows.withColumns(first).withColumn("article_id", null("bigint")).select(*MADE), None
        width = left = before = None
        while True:
            # What a round writes is kept until the next one stands.
            own = held.enter_context(ExitStack())
            keep = own.enter_context(work.tables(spark))
            open_ = keep(_open_at(made, slices))
            states = open_.groupBy("component", F.col("at").alias("slice")).agg(F.count("*").alias("open"), F.bit_xor("print").alias("state"))
            states = slices.select(*slot).join(states, slot, "left").select(*slot, F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("state", F.lit(0)).alias("state"))
            if used is None:
                todo = keep(states)
            else:
                todo = keep(states.join(used.withColumnsRenamed({"open": "o", "state": "s"}), slot).where("open <> o OR state <> s").select(*states.columns))
            heads = todo.groupBy("component").agg(F.min("slice").alias("head"))
            behind = slices.join(heads, "component").where("slice >= head").count()
            if not behind:
                break
            if left is not None:
                # At least a quarter of what a round folds should come to stand, or fewer are folded.
                width = max(1, (width or ran) // 2) if 4 * (left - behind) < ran else (width and 2 * width)
            left = behind
            if width:
                todo = keep(todo.join(heads, "component").where(F.col("slice") < F.col("head") + width).drop("head"))
            ran, large = todo.agg(F.count("*"), F.count_if(F.col("open") > BLOCK)).first()
            now = todo.select(*slot, (F.col("open") > BLOCK).alias("tiled"))
            arts = rows.join(now, slot)
            asked = arts.select(*article, "tiled")
            known = made.where("kind = 'story'").join(open_.select("component", "slice", "story_id", "at"), ["component", "slice", "story_id"])
            known = known.select(*stored).join(now, slot)
            if large:
                blocks = todo.where(F.col("open") > BLOCK).select(*slot, F.ceil(F.col("open") / BLOCK).alias("blocks"))
                a = arts.select(*article).join(blocks, slot).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
                s = known.drop("tiled").join(blocks, slot).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
                both = s.unionByName(a).select(*slot, "block", "id", "at", "vector", "last").repartition(*slot, "block").sortWithinPartitions(*slot, "block")
                pairs = both.mapInPandas(_tiles(join, *slot, "block"), "article_id bigint, story_id bigint, similarity double")
                pairs = keep(pairs.join(rows.select("article_id", *slot), "article_id"))
                found = pairs.groupBy(F.col("article_id").alias("id")).agg(F.collect_list(F.struct("story_id", "similarity")).alias("near"))
                asked = asked.join(found, "id", "left")
                met = pairs.select(*slot, F.col("story_id").alias("id")).distinct()
                known = known.where("NOT tiled").unionByName(known.where("tiled").join(met, [*slot, "id"], "left_semi"))
            else:
                asked = asked.withColumn("near", near)
            asked = known.withColumn("near", near).unionByName(asked)
            asked = asked.repartition(max(1, min(ran, most)), *slot).sortWithinPartitions(*slot, F.asc_nulls_last("last"), "at", "id")
            done = asked.mapInPandas(_slice_fold(join, k), schema)
            kept = made.join(now.select(*slot), slot, "left_anti").select(*MADE)
            made = keep(kept.unionByName(done))
            states = todo.select(*slot, "open", "state")
            used = keep(states if used is None else used.join(states.select(*slot), slot, "left_anti").unionByName(states))
            if before is not None:
                before.close()
            before = own
        return table(made.where("kind = 'decision'").select(*DECISION), keep=True)

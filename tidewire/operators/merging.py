"""What a pass of merges changes, worked out from the merged stories alone."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class StoryTables(NamedTuple):
    """What is kept about stories, in forms that can be added up.

    means(story_id, place, n, total): members that have a number there, and their sum; outlets(story_id, domain, n);
    entities(story_id, entity_id, mention_count).
    """

    means: DataFrame
    outlets: DataFrame
    entities: DataFrame


_SUMS = {"means": (["place"], ["n", "total"]), "outlets": (["domain"], ["n"]), "entities": (["entity_id"], ["mention_count"])}


def counted(members: DataFrame, vectors: DataFrame, edges: DataFrame) -> StoryTables:
    """The tables counted from members(story_id, article_id, domain), vectors(article_id, vector), edges(article_id, entity_id, mention_count)."""
    own = members.select("story_id", "article_id")
    places = own.join(vectors, "article_id").select("story_id", F.posexplode("vector").alias("place", "x"))
    means = places.groupBy("story_id", "place").agg(F.count("x").alias("n"), F.sum(F.col("x").cast("double")).alias("total"))
    outlets = members.groupBy("story_id", "domain").agg(F.count("*").alias("n"))
    entities = own.join(edges, "article_id").groupBy("story_id", "entity_id").agg(F.sum("mention_count").alias("mention_count"))
    return StoryTables(means, outlets, entities)


def _moved(table: DataFrame, keys: list[str], sums: list[str], merges: DataFrame) -> DataFrame:
    """A table after merges(survivor_id, absorbed_id): rows of stories that take no part are passed on as they are."""
    to = merges.select(F.col("absorbed_id").alias("story_id"), F.col("survivor_id").alias("to"))
    to = to.unionByName(merges.select(F.col("survivor_id").alias("story_id"), F.col("survivor_id").alias("to"))).distinct()
    rows = table.join(to, "story_id", "left")
    kept = rows.where("to IS NULL").select(*table.columns)
    added = rows.where("to IS NOT NULL").groupBy(F.col("to").alias("story_id"), *keys).agg(*(F.sum(c).alias(c) for c in sums))
    return kept.unionByName(added.select(*table.columns))


def after_merges(tables: StoryTables, merges: DataFrame) -> StoryTables:
    """The tables after a pass: survivors have their own and the absorbed stories' counts, absorbed ones have none.

    Only rows of stories that take part are added up; the result is that of counted() on the members after
    the pass. A pass absorbs no survivor.
    """
    return StoryTables(*(_moved(t, *_SUMS[name], merges) for name, t in zip(StoryTables._fields, tables, strict=True)))


def after_removal(tables: StoryTables, gone: StoryTables) -> StoryTables:
    """The tables without the members that `gone` counts (of the same stories): what falls to nothing goes."""
    out = []
    for name, table, less in zip(StoryTables._fields, tables, gone, strict=True):
        keys, sums = _SUMS[name]
        minus = less.select("story_id", *keys, *((-F.col(c)).alias(c) for c in sums))
        touched = less.select("story_id", *keys).distinct()
        kept = table.join(touched, ["story_id", *keys], "left_anti")
        added = table.join(touched, ["story_id", *keys], "left_semi").unionByName(minus).groupBy("story_id", *keys).agg(*(F.sum(c).alias(c) for c in sums))
        out.append(kept.unionByName(added.where(F.col(sums[0]) != 0).select(*table.columns)))
    return StoryTables(*out)


def summary(tables: StoryTables) -> DataFrame:
    """(story_id, outlets, entities, mentions, mean): what readers of a story see."""
    outlets = tables.outlets.groupBy("story_id").agg(F.count("*").alias("outlets"), F.sum("n").alias("members"))
    entities = tables.entities.groupBy("story_id").agg(F.count("*").alias("entities"), F.sum("mention_count").alias("mentions"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("place", (F.col("total") / F.col("n")).alias("x")))), lambda s: s["x"])
    means = tables.means.groupBy("story_id").agg(mean.alias("mean"))
    return outlets.join(entities, "story_id", "left").join(means, "story_id", "left")

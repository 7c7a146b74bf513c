"""Which entities may license a join: document frequency, aliases, mastheads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.schemas import GUARD_EXCLUDED

from . import work

# Fixed values.
MAX_FRACTION, MIN_FLOOR = 0.10, 5
#: Rows of a key up to which its list of entities goes with each of them; entities in all these lists that are shuffled at a time, about 0.6 GB.
LISTED, AT_ONCE = 64, 1 << 27


def document_frequency(edges: DataFrame) -> DataFrame:
    """(entity_id, df) over edges(article_id, entity_id)."""
    return edges.groupBy("entity_id").agg(F.countDistinct("article_id").alias("df"))


def threshold(articles: DataFrame, fraction: float = MAX_FRACTION, floor: int = MIN_FLOOR) -> DataFrame:
    """One row: articles above which an entity is too common. articles: those with entities extracted."""
    n = F.countDistinct("article_id")
    return articles.agg(n.alias("corpus"), F.greatest(F.lit(floor), F.ceil(n * F.lit(fraction))).cast("bigint").alias("ceiling"))


def alias_groups(entities: DataFrame) -> DataFrame:
    """(entity_id, group_id): the entity whose name is this one's longest proper suffix, of one type; one hop.

    Each name is exploded into its whole-word suffixes and meets names of its type by an
    equi-join; of names that differ in case and spaces only, the smallest id stands.
    """
    named = entities.select("entity_id", "entity_type", text.spaced_name(F.col("name")).alias("key"))
    owners = named.groupBy("entity_type", "key").agg(F.min("entity_id").alias("target"))
    words = F.split("key", " ")
    suffix = named.select("entity_id", "entity_type", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i + 1, F.size(words)), " "))).alias("at", "key")).where("key <> ''")
    hits = suffix.join(owners, ["entity_type", "key"]).where("target <> entity_id")
    best = hits.groupBy("entity_id").agg(F.min_by("target", "at").alias("target"))
    return entities.select("entity_id").join(best, "entity_id", "left").select("entity_id", F.coalesce("target", "entity_id").alias("group_id"))


def overexposed(edges: DataFrame, entities: DataFrame, articles: DataFrame, fraction: float = MAX_FRACTION, floor: int = MIN_FLOOR) -> DataFrame:
    """Entities whose alias group is in too many articles; a group's exposure is the sum of its rows'."""
    df = document_frequency(edges)
    known = df.join(entities, "entity_id").select("entity_id", "name", "entity_type", "df")
    grouped = known.join(alias_groups(known), "entity_id")
    total = grouped.withColumn("exposure", F.sum("df").over(Window.partitionBy("group_id")))
    limit = threshold(articles, fraction, floor).select("ceiling")  # one row
    return total.join(F.broadcast(limit), F.col("exposure") > F.col("ceiling")).select("entity_id", "group_id", "exposure")


def article_guard(edges: DataFrame, entities: DataFrame, over: DataFrame, domains: DataFrame) -> DataFrame:
    """(article_id, entity_id) that may license a join: not too common, not OTHER, not the masthead.

    domains: (article_id, domain).
    """
    rows = edges.select("article_id", "entity_id").distinct().join(entities, "entity_id").where(~F.col("entity_type").isin(*GUARD_EXCLUDED))
    rows = rows.join(over.select("entity_id"), "entity_id", "left_anti").join(domains.dropDuplicates(["article_id"]), "article_id", "left")
    own = F.array_contains(F.coalesce(text.publisher_labels(F.col("domain")), F.array().cast("array<string>")), text.compact_name(F.col("name")))
    return rows.where(~own).select("article_id", "entity_id")


def story_guard(story_edges: DataFrame, entities: DataFrame, over: DataFrame, members: DataFrame) -> DataFrame:
    """(story_id, entity_id); the masthead counts as long as all members have one domain.

    members: (story_id, domain) of each member article.
    """
    lone = members.groupBy("story_id").agg(F.countDistinct("domain").alias("n"), F.min("domain").alias("domain")).where("n = 1").select("story_id", "domain")
    rows = story_edges.select("story_id", "entity_id").distinct().join(entities, "entity_id").where(~F.col("entity_type").isin(*GUARD_EXCLUDED))
    rows = rows.join(over.select("entity_id"), "entity_id", "left_anti").join(lone, "story_id", "left")
    own = F.array_contains(F.coalesce(text.publisher_labels(F.col("domain")), F.array().cast("array<string>")), text.compact_name(F.col("name")))
    return rows.where(~own).select("story_id", "entity_id")


def _counted(rows: DataFrame, key: str, out: str) -> DataFrame:
    """(out, entity_id, _n) with the number of the key's rows."""
    rows = rows.where("entity_id IS NOT NULL").select(F.col(key).alias(out), "entity_id").withColumn("_n", F.count("*").over(Window.partitionBy(out)))
    with work.tables(rows.sparkSession) as table, work.released(rows.sparkSession):
        return table(rows, keep=True)  # read more than once


def _lists(rows: DataFrame, out: str) -> DataFrame:
    """(out, list) of each key with LISTED rows at most."""
    return rows.where(F.col("_n") <= LISTED).groupBy(out).agg(F.array_sort(F.collect_list("entity_id")).alias("list"))


def shared(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """(a_key, b_key, shared): pairs with a guard entity in common. Over-common ones are gone, so blocks stay small.

    The rows of a key bring its whole list of entities along, so a pair is counted where its least common
    entity meets: pairs are not shuffled. Only those of keys with more than LISTED rows are, to be grouped.
    Lists are many times as long as the rows. Where they have more than AT_ONCE entities, entities meet in parts, one part after another,
    and a part's shuffle files go before the next: the disk holds one part of them, the rows and the result.
    Rows that repeat an entity of a key count as often as they meet.
    """
    spark, a, b = a.sparkSession, _counted(a, a_key, "_a"), _counted(b, b_key, "_b")
    a_lists, b_lists = _lists(a, "_a"), _lists(b, "_b")
    with work.released(spark):
        sent = sum(x.where(F.col("_n") <= LISTED).agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] for x in (a, b))
    parts = max(1, -(-sent // AT_ONCE))
    if parts == 1:
        found = [_met(a_lists, b_lists)]
    else:
        with work.tables(spark) as table, work.released(spark):
            a_lists, b_lists = table(a_lists), table(b_lists)
            found = [table(_met(a_lists, b_lists, part, parts), keep=True) for part in range(parts)]
    a_long, b_long = (x.where(F.col("_n") > LISTED).drop("_n") for x in (a, b))
    some = lambda x, y: x.join(y, "entity_id").select("_a", "_b")
    rest = [some(a_long, b)] if not a_long.isEmpty() else []
    rest += [some(a.where(F.col("_n") <= LISTED), b_long)] if not b_long.isEmpty() else []
    if rest:
        found.append(reduce(DataFrame.unionByName, rest).groupBy("_a", "_b").agg(F.count("*").alias("shared")))
    return reduce(DataFrame.unionByName, found).select(F.col("_a").alias(a_key), F.col("_b").alias(b_key), "shared")


def _met(a_lists: DataFrame, b_lists: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """(_a, _b, shared) of keys whose least common entity is in this part of all entities."""

    def rows(lists: DataFrame, out: str) -> DataFrame:
        once = F.array_distinct("list")
        here = once if parts == 1 else F.filter(once, lambda x: F.pmod(F.xxhash64(x), F.lit(parts)) == part)
        return lists.select(out, F.explode(here).alias("entity_id"), "list", (F.size("list") > F.size(once)).alias("twice"))

    met = rows(a_lists, "_a").join(rows(b_lists, "_b").withColumnsRenamed({"list": "b_list", "twice": "b_twice"}), "entity_id")
    met = met.select("*", F.array_intersect("list", "b_list").alias("both")).where(F.get("both", F.lit(0)) == F.col("entity_id"))
    times = F.aggregate("list", F.lit(0).cast("bigint"), lambda s, x: s + F.size(F.filter("b_list", lambda y: y == x)))
    return met.select("_a", "_b", F.when(F.col("twice") | F.col("b_twice"), times).otherwise(F.size("both").cast("bigint")).alias("shared"))

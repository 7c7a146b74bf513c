"""Stores of what workers send: vectors, entities, claims with evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text, vectors

from . import clustering, tables


def store_vectors(articles: DataFrame, sent: DataFrame, dim: int, now: Column) -> DataFrame:
    """articles(article_id, embedding, embedded_at) after batches sent(batch, article_id, vector).

    A batch is stored whole or, where one vector has a wrong length or norm, not at all. Ids
    that aren't known change nothing. Of repeats, the last batch wins.
    """
    good = vectors.batch_valid(sent, "batch", "vector", dim).where("accepted").select("batch")
    new = sent.join(good, "batch", "left_semi").groupBy("article_id").agg(F.max_by("vector", "batch").alias("embedding"))
    return tables.update_from(articles, new.withColumn("embedded_at", now), "article_id", ["embedding", "embedded_at"])


def unknown_ids(sent: DataFrame, articles: DataFrame) -> DataFrame:
    return sent.select("article_id").distinct().join(articles.select("article_id"), "article_id", "left_anti")


def store_entities(edges: DataFrame, sent: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, story entities) after sent(article_id, entity_id, mention_count): an article's set is replaced, its stories are resynced.

    An article that was sent with a null entity has none now.
    """
    kept = tables.replace_sets(edges, sent.where("entity_id IS NOT NULL"), "article_id", sent.select("article_id").distinct())
    return kept, clustering.resync(members, kept)


@dataclass
class ClaimStore:
    """stories(story_id, risk_tier, claims_extracted), claims, evidence, and runs(story_id, provider, status, error) of one delivery."""

    stories: DataFrame
    claims: DataFrame
    evidence: DataFrame
    runs: DataFrame


def store_claims(current: ClaimStore, items: DataFrame, articles: DataFrame, model: str) -> ClaimStore:
    """The store after items(story_id, error, risk_tier, claims) of one delivery.

    claims: array of (claim_text, claim_type, confidence, evidence array of (article_id, quote)).
    articles: (article_id, source_id, url, published_at). Every known story of the delivery
    counts as extracted. A failed item (error) leaves a run and its earlier claims; another
    one replaces the story's claims and risk tier. Evidence of unknown articles goes, and a
    claim without any is not stored; quotes and errors are cut to their limits.
    """
    known = items.join(current.stories.select("story_id"), "story_id", "left_semi")
    good = known.where("error IS NULL")
    parts = good.select("story_id", F.posexplode("claims").alias("ord", "c")).select("story_id", "ord", "c.*")
    cited = parts.select("story_id", "ord", F.explode("evidence").alias("e")).select("story_id", "ord", F.col("e.article_id").alias("article_id"), F.left(F.col("e.quote"), F.lit(text.MOST_QUOTE)).alias("quote"))
    evidence = cited.join(articles, "article_id").select("story_id", "ord", "article_id", "source_id", "url", "quote", F.lit("supports").alias("stance"), "published_at")
    per = evidence.groupBy("story_id", "ord").agg(F.countDistinct("source_id").alias("supporting_source_count"), F.min("published_at").alias("first_asserted_at"))
    claims = parts.join(per, ["story_id", "ord"]).select("story_id", "ord", "claim_text", "claim_type", "confidence", "supporting_source_count", "first_asserted_at")
    owners = good.select("story_id").distinct()
    tier = known.groupBy("story_id").agg(F.max_by("risk_tier", F.when(F.col("error").isNull(), 1).otherwise(0)).alias("_tier"), F.bool_or(F.col("error").isNull()).alias("_good"))
    stories = current.stories.join(tier, "story_id", "left").select(
        "story_id", F.when(F.col("_good"), F.coalesce("_tier", F.lit("standard"))).otherwise(F.col("risk_tier")).alias("risk_tier"),
        (F.col("claims_extracted") | F.col("_good").isNotNull()).alias("claims_extracted"),
    )
    runs = known.select(
        "story_id", text.model_provider(F.lit(model)).alias("provider"), F.when(F.col("error").isNull(), "ok").otherwise("invalid_output").alias("status"),
        F.left("error", F.lit(text.MOST_QUOTE)).alias("error"),
    )
    return ClaimStore(
        stories, tables.replace_sets(current.claims, claims, "story_id", owners),
        tables.replace_sets(current.evidence, evidence.drop("published_at"), "story_id", owners), current.runs.unionByName(runs),
    )


def attributed(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """claims with the name that they are attributed to; empty without one."""
    named = entities.select(F.col("entity_id").alias("attributed_to_entity_id"), F.col("name").alias("attributed_to"))
    return claims.join(named, "attributed_to_entity_id", "left").withColumn("attributed_to", F.coalesce("attributed_to", F.lit("")))


def entity_marks(story_edges: DataFrame, entities: DataFrame, story_guard: DataFrame) -> DataFrame:
    """(story_id, marks): a story's entities by name, + before those that may license a join, - before others."""
    may = story_guard.select("story_id", "entity_id", F.lit("+").alias("mark"))
    rows = story_edges.select("story_id", "entity_id").distinct().join(entities, "entity_id").join(may, ["story_id", "entity_id"], "left")
    shown = F.concat(F.coalesce("mark", F.lit("-")), F.lit(" "), "name", F.lit(" ("), "entity_type", F.lit(")"))
    return rows.groupBy("story_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "entity_id", shown.alias("shown")))), lambda x: x["shown"]), ", ").alias("marks"))


def missed_joins(verdicts: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs that a human called one event: what kept them apart, and the entities of both sides.

    verdicts: (story_id, other_id, verdict, similarity, shared).
    """
    same = verdicts.where("verdict = 'same_event'")
    out = same.join(marks, "story_id", "left").join(marks.toDF("other_id", "other_marks"), "other_id", "left")
    none = F.lit("(none)")
    why = clustering.blocker(F.coalesce("similarity", F.lit(0.0)), F.coalesce("shared", F.lit(0)))
    return out.select("story_id", "other_id", "similarity", why.alias("blocked_by"), F.coalesce("marks", none).alias("marks"), F.coalesce("other_marks", none).alias("other_marks"))


def recall(verdicts: DataFrame, joined: Column | int) -> DataFrame:
    """One row: joins made over joins that should have been made; unsure pairs count nowhere, and nothing judged gives null."""
    missed = F.count_if(F.col("verdict") == "same_event")
    made = F.lit(joined)
    return verdicts.agg(made.cast("bigint").alias("joined"), missed.alias("missed"), F.count("*").alias("judged"), F.try_divide(made, made + missed).alias("recall"))

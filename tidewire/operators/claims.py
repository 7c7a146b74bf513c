"""Claims: storing, cross-source verification, contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.schemas import CHECKABLE_CLAIMS

#: Rows of claims, old and new, that meet in one task.
PART = 1 << 18


def verification(evidence: DataFrame) -> DataFrame:
    """Status of each claim from evidence(claim_id, source_id, is_authority, content_hash).

    An authority wins; two sources with two contents, nulls aside, corroborate.
    """
    per = evidence.groupBy("claim_id").agg(
        F.bool_or("is_authority").alias("authority"), F.countDistinct("source_id").alias("sources"), F.countDistinct("content_hash").alias("contents")
    )
    status = F.when(F.col("authority"), "authoritative").when((F.col("sources") >= 2) & (F.col("contents") >= 2), "corroborated").otherwise("single_source")
    return per.select("claim_id", status.alias("verification_status"), "sources", "contents")


def _status(evidence: DataFrame) -> DataFrame:
    """verification() without its counts: two values differ if the least and the largest do, so one pass with a few numbers a claim tells.

    Contents are compared by 128 bits of two hashes, which aggregates of fixed size hold.
    """
    content = F.col("content_hash")
    hashes = [F.when(content.isNotNull(), h) for h in (F.xxhash64(content), F.xxhash64(F.lit(1), content))]
    spread = lambda n, c: [F.min(c).alias(f"least{n}"), F.max(c).alias(f"most{n}")]
    per = evidence.groupBy("claim_id").agg(F.bool_or("is_authority").alias("authority"), *spread(0, F.col("source_id")), *spread(1, hashes[0]), *spread(2, hashes[1]))
    two = lambda n: F.coalesce(F.col(f"least{n}") != F.col(f"most{n}"), F.lit(False))
    status = F.when(F.col("authority"), "authoritative").when(two(0) & (two(1) | two(2)), "corroborated").otherwise("single_source")
    return per.select("claim_id", status.alias("verification_status"))


def verify(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims with new statuses; only unverified ones change, those without evidence stay so."""
    found = _status(evidence).select("claim_id", F.col("verification_status").alias("_new"))
    new = F.when(F.col("verification_status") == "unverified", F.coalesce("_new", "verification_status")).otherwise(F.col("verification_status"))
    return claims.join(found, "claim_id", "left").withColumn("verification_status", new).drop("_new")


def support(evidence: DataFrame) -> DataFrame:
    """(claim_id, supporting_source_count, first_asserted_at) from evidence with asserted_at."""
    return evidence.groupBy("claim_id").agg(F.countDistinct("source_id").alias("supporting_source_count"), F.min("asserted_at").alias("first_asserted_at"))


def store(current: DataFrame, extracted: DataFrame, articles: DataFrame, failed: DataFrame) -> DataFrame:
    """Replace the claims of stories that were extracted anew; those of failed items stay.

    extracted: (story_id, claim_text, claim_type, article_id); evidence that names no known
    article goes, and a claim left without evidence is not stored. All rows meet in one shuffle, dealt
    by story over parts whose number follows from the counted rows, so what a task holds doesn't grow with the tables.
    """
    parts = max(int(current.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(current.count() + extracted.count()) // PART))
    claim, none = ["story_id", "claim_text", "claim_type"], F.lit(None)
    known = articles.select("article_id").distinct().withColumn("good", F.lit(True))
    rows = current.select(*claim, F.lit("old").alias("kind"), F.lit(True).alias("good"))
    rows = rows.unionByName(extracted.join(known, "article_id", "left").select(*claim, F.lit("new").alias("kind"), F.coalesce("good", F.lit(False)).alias("good")))
    kinds = {c: current.schema[c].dataType for c in claim[1:]}
    rows = rows.unionByName(failed.select("story_id", *(none.cast(t).alias(c) for c, t in kinds.items()), F.lit("failed").alias("kind"), F.lit(False).alias("good")))
    rows = rows.repartition(parts, "story_id").groupBy(*claim, "kind").agg(F.bool_or("good").alias("good"), F.count("*").alias("n"))
    w = Window.partitionBy("story_id")
    has = lambda kind: F.col("story_id").isNotNull() & F.max(F.col("kind") == kind).over(w)
    rows = rows.select("*", has("new").alias("extracted"), has("failed").alias("failed"))
    stays = (F.col("kind") == "old") & ~(F.col("extracted") & ~F.col("failed"))
    comes = (F.col("kind") == "new") & F.col("good") & ~F.col("failed")
    copies = F.sequence(F.lit(1).cast("bigint"), F.when(F.col("kind") == "old", F.col("n")).otherwise(1))
    return rows.where(stays | comes).select(*claim, F.explode(copies).alias("_copy")).drop("_copy")


def checkable(claims: DataFrame) -> DataFrame:
    """Claims of the kinds that can contradict each other, in stories that have two."""
    kinds = claims.where(F.col("claim_type").isin(*CHECKABLE_CLAIMS))
    return kinds.withColumn("_n", F.count("*").over(Window.partitionBy("story_id"))).where("_n >= 2").drop("_n")


def contradictions(claims: DataFrame, pairs: DataFrame, existing: str | None = None) -> DataFrame:
    """(claim_id, verification_status, contradicted_by) after pairs(ord, a, b, reason).

    Statuses are those before any pair: if one side alone is authoritative, the other is
    refuted and gets the entry; else both are disputed. Refuted beats disputed. Entries
    (claim, reason) keep the pairs' order and go behind those of the column `existing`.
    """
    st = claims.select("claim_id", (F.col("verification_status") == "authoritative").alias("auth"))
    known = pairs.select("ord", "a", "b", "reason").join(st.toDF("a", "auth_a"), "a").join(st.toDF("b", "auth_b"), "b")
    side = lambda x, y: F.struct(F.col(x).alias("claim_id"), F.col(y).alias("other"), F.col(f"auth_{x}").alias("auth"), F.col(f"auth_{y}").alias("other_auth"))
    sided = known.select("ord", "reason", F.inline(F.array(side("a", "b"), side("b", "a"))))  # both ways once their statuses are known
    weight = F.when(F.col("other_auth") & ~F.col("auth"), 2).when(F.col("auth") & ~F.col("other_auth"), 0).otherwise(1)
    entry = F.struct("ord", "other", "reason")
    per = sided.withColumn("w", weight).where("w > 0").groupBy("claim_id").agg(F.max("w").alias("w"), F.array_sort(F.collect_list(entry)).alias("by"))
    new = F.when(F.col("w") == 2, "refuted").when(F.col("w") == 1, "disputed")
    entries = F.transform("by", lambda s: F.struct(s["other"].alias("claim_id"), s["reason"].alias("reason")))
    none = F.array().cast("array<struct<claim_id:bigint,reason:string>>")
    before = F.coalesce(F.col(existing), none) if existing else none
    return claims.join(per, "claim_id", "left").select(
        "claim_id", F.coalesce(new, "verification_status").alias("verification_status"), F.concat(before, F.coalesce(entries, none)).alias("contradicted_by")
    )

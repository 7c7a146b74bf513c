"""Markers, guarded updates, id resolution, roles, audit rows, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ready(articles: DataFrame) -> DataFrame:
    """Embedded, extracted and in no story yet; duplicates are not left out."""
    return articles.where(F.col("embedding").isNotNull() & F.col("entities_extracted_at").isNotNull() & F.col("story_id").isNull())


def is_recent(at: str, now: Column, hours: int = 48) -> Column:
    """At the very boundary a row is recent, and stale too."""
    return F.col(at) >= now - F.expr(f"INTERVAL {hours} HOURS")


def is_stale(at: str, now: Column, hours: int = 48) -> Column:
    return F.col(at) <= now - F.expr(f"INTERVAL {hours} HOURS")


def guarded_update(base: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """corrections(key, expected, value) take effect where the column still has the expected value."""
    c = corrections.select(key, F.col("expected").alias("_was"), F.col("value").alias("_new"))
    out = base.join(c, key, "left")
    return out.withColumn(column, F.when(F.col(column) == F.col("_was"), F.col("_new")).otherwise(F.col(column))).drop("_was", "_new")


def resolve(refs: DataFrame, table: DataFrame, ref: str, id_col: str) -> DataFrame:
    """refs with their ids; what isn't known keeps a null id and says so."""
    return refs.join(table.select(ref, id_col), ref, "left").withColumn("unknown", F.col(id_col).isNull())


def may(roles: Column, *needed: str) -> Column:
    """Roles that allow; admin implies all."""
    return F.array_contains(roles, "admin") | F.arrays_overlap(roles, F.array(*map(F.lit, needed)))


def token_valid(digest: Column, current: Column, previous: Column, grace_until: Column, now: Column) -> Column:
    """The current token, or the previous one until its grace ends."""
    return (digest == current) | ((digest == previous) & (grace_until > now))


def audit(before: DataFrame, after: DataFrame, key: str, columns: list[str], actor: str, now: Column) -> DataFrame:
    """A row for each changed one: key, actor, at, before and after as JSON."""
    a, b = (df.select(key, F.to_json(F.struct(*columns)).alias(s)) for df, s in ((before, "before"), (after, "after")))
    both = a.join(b, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select(key, F.lit(actor).alias("actor"), now.alias("at"), "before", "after")


def reset_quota(providers: DataFrame, now: Column) -> DataFrame:
    """Quotas of earlier days start anew."""
    new_day = F.col("quota_day") < F.to_date(now)
    return providers.withColumn("quota_used", F.when(new_day, 0).otherwise(F.col("quota_used"))).withColumn("quota_day", F.greatest("quota_day", F.to_date(now)))

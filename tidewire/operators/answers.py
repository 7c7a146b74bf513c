"""What models answer: checked claims, index translation, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of claims, those that need an attribution, tiers of risk.
CLAIM_KINDS = ("FACT", "CLAIM", "ALLEGATION", "OPINION", "ANALYSIS", "PREDICTION", "PROJECTION", "OFFICIAL_STATEMENT", "UNVERIFIED")
ATTRIBUTED = ("CLAIM", "ALLEGATION", "OFFICIAL_STATEMENT")
TIERS = ("standard", "elevated", "high")
#: The shape of an answer; what is not JSON of this shape reads as null.
ANSWER = (
    "claims array<struct<claim_text:string,claim_type:string,attributed_to:string,confidence:double,evidence:array<struct<source_article_id:string,quote:string>>>>, "
    "injection_detected boolean, risk_tier string, risk_reasons array<string>, _corrupt_record string"
)


def _claim_problem(c: Column) -> Column:
    """The first rule that a claim breaks."""
    evidence = c["evidence"]
    whole = c["confidence"] == F.floor(c["confidence"])
    return (
        F.when(c["claim_text"].isNull(), "claim_text")
        .when(~F.coalesce(c["claim_type"].isin(*CLAIM_KINDS), F.lit(False)), "claim_type")
        .when(~F.coalesce(whole & c["confidence"].between(0, 100), F.lit(False)), "confidence")
        .when(F.coalesce(F.size(evidence), F.lit(0)) < 1, "evidence")
        .when(F.exists(evidence, lambda e: e["source_article_id"].isNull() | e["quote"].isNull()), "evidence")
        .when(c["claim_type"].isin(*ATTRIBUTED) & (F.coalesce(c["attributed_to"], F.lit("")) == ""), "attributed_to")
    )


def checked(answers: DataFrame, raw: str = "answer") -> DataFrame:
    """answers with what the raw JSON says (`said`) and why it can't be taken (`problem`, null if it can).

    All rules are expressions, so bad answers cost nothing but their row: malformed JSON, a
    missing list or tier, a kind or tier that isn't known, confidence out of range, no
    evidence, a missing attribution.
    """
    out = answers.withColumn("said", F.from_json(F.col(raw), ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    said = F.col("said")
    broken = F.filter(F.transform(said["claims"], _claim_problem), lambda p: p.isNotNull())
    problem = (
        F.when(said.isNull() | said["_corrupt_record"].isNotNull() | ~F.coalesce(F.col(raw).rlike(r"^\s*\{"), F.lit(False)), "malformed")
        .when(said["claims"].isNull(), "claims")
        .when(~F.coalesce(said["risk_tier"].isin(*TIERS), F.lit(False)), "risk_tier")
        .otherwise(F.try_element_at(broken, F.lit(1)))
    )
    return out.withColumn("problem", problem)


def translated(pairs: DataFrame, checkable: DataFrame) -> DataFrame:
    """pairs(story_id, a, b, reason) of places in a story's checkable claims, as places in all its claims.

    checkable: (story_id, places), places counted from 0. Pairs out of range are dropped.
    """
    rows = pairs.join(checkable, "story_id")
    n = F.size("places")
    good = rows.where((F.col("a") >= 0) & (F.col("a") < n) & (F.col("b") >= 0) & (F.col("b") < n))
    place = lambda c: F.element_at("places", (F.col(c) + 1).cast("int"))
    return good.select("story_id", place("a").alias("a"), place("b").alias("b"), "reason")


def merged_flags(title: Column, body: Column, hidden_blocks: Column) -> Column:
    """The flags document of an item: hits by field where there are any, and always a list `patterns`."""
    has = lambda hits: F.when(F.size(hits) > 0, F.struct(hits.alias("patterns")))
    none = F.array().cast("array<string>")
    return F.to_json(F.struct(has(title).alias("title"), has(body).alias("body"), F.when(hidden_blocks > 0, hidden_blocks).alias("hidden_html_blocks"), none.alias("patterns")))


def flagged_top_level(flags: Column) -> Column:
    """Whether the document's own list of patterns has any."""
    return F.coalesce(F.json_array_length(F.get_json_object(flags, "$.patterns")), F.lit(0)) > 0


def flagged_any(flags: Column) -> Column:
    """Whether any list of patterns in it has any, that of the title and the body included."""
    lists = [F.coalesce(F.json_array_length(F.get_json_object(flags, f"$.{path}")), F.lit(0)) for path in ("patterns", "title.patterns", "body.patterns")]
    return lists[0] + lists[1] + lists[2] > 0


def as_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the rows as a map, in order of the key. For dimensions: each key is one entry."""
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("map"))

"""Relevance to a country from a story's entities and publishers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import spaced_name

# Weights of the two signals, and their share of the full formula.
WEIGHT_ENTITIES, WEIGHT_PUBLISHERS = 0.30, 0.20
COVERAGE = WEIGHT_ENTITIES + WEIGHT_PUBLISHERS
# Names, lower case and spaced, that mark a story as American.
US_MARKERS = (
    "united states", "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana",
    "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire",
    "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee",
    "texas", "utah", "vermont", "virginia", "washington state", "west virginia", "wisconsin", "wyoming", "washington, d.c", "washington dc", "district of columbia", "congress",
    "house of representatives", "senate", "white house", "supreme court", "pentagon", "federal reserve", "fbi", "cia", "irs", "sec", "ftc", "doj", "ice", "usps", "nasa", "epa", "cdc", "fda",
)


def is_us(name: Column) -> Column:
    return spaced_name(name).isin(*US_MARKERS)


def entity_signal(story_entities: DataFrame, marker: Column) -> DataFrame:
    """(story_id, entity_signal): distinct marker names over all rows that aren't OTHER."""
    rows = story_entities.where("entity_type <> 'OTHER'")
    return rows.groupBy("story_id").agg((F.countDistinct(F.when(marker, F.col("name"))) / F.count("*")).alias("entity_signal"))


def publisher_signal(members: DataFrame, country: str) -> DataFrame:
    """(story_id, us_sources, total_sources, publisher_signal) by member article."""
    own = F.count_if(F.col("country") == country)
    return members.groupBy("story_id").agg(own.alias("us_sources"), F.count("*").alias("total_sources"), (own / F.count("*")).alias("publisher_signal"))


def relevance(story_entities: DataFrame, members: DataFrame, marker: Column, country: str) -> DataFrame:
    """0-100, rounded half to even; a missing signal is 0."""
    both = entity_signal(story_entities, marker).join(publisher_signal(members, country), "story_id", "full_outer")
    both = both.select(
        "story_id", F.coalesce("entity_signal", F.lit(0.0)).alias("entity_signal"), F.coalesce("publisher_signal", F.lit(0.0)).alias("publisher_signal"),
        F.coalesce("us_sources", F.lit(0)).alias("us_sources"), F.coalesce("total_sources", F.lit(0)).alias("total_sources"),
    )
    raw = F.col("entity_signal") * (WEIGHT_ENTITIES / COVERAGE) + F.col("publisher_signal") * (WEIGHT_PUBLISHERS / COVERAGE)
    return both.withColumn("score", F.bround(raw * 100).cast("int"))


def basis(scored: DataFrame) -> DataFrame:
    """The document that says what a score rests on."""
    doc = F.struct(
        F.lit(1).alias("formula_version"),
        F.lit(COVERAGE).alias("coverage"),
        F.struct(
            F.struct(F.lit(WEIGHT_ENTITIES).alias("weight"), F.bround("entity_signal", 4).alias("value")).alias("us_entities"),
            F.struct(F.lit(WEIGHT_PUBLISHERS).alias("weight"), F.bround("publisher_signal", 4).alias("value"), "us_sources", "total_sources").alias("us_publisher_share"),
        ).alias("signals"),
    )
    return scored.withColumn("basis", F.to_json(doc))


def salience(mentions: DataFrame) -> DataFrame:
    """mentions(article_id, entity_id, n) with each entity's share of its article's mentions."""
    from pyspark.sql import Window

    share = F.col("n") / F.sum("n").over(Window.partitionBy("article_id"))
    return mentions.withColumn("salience", F.bround(share, 3))

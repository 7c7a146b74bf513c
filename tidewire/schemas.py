"""Closed value sets and row types of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
ENTITY_TYPES = ("PERSON", "ORG", "PLACE", "EVENT", "PRODUCT", "LEGISLATION", "OTHER")
VERIFICATION = ("unverified", "single_source", "corroborated", "authoritative", "disputed", "refuted")
DEDUP = ("pending", "unique", "exact_duplicate", "near_duplicate")
JOB_STATUS = ("queued", "leased", "done", "failed", "cancelled")
CIRCUIT = ("closed", "open", "half_open")
CLAIM_TYPES = ("FACT", "CLAIM", "ALLEGATION", "OPINION", "ANALYSIS", "PREDICTION", "PROJECTION", "OFFICIAL_STATEMENT", "UNVERIFIED")
CHECKABLE_CLAIMS = ("FACT", "CLAIM", "ALLEGATION", "OFFICIAL_STATEMENT", "PROJECTION")
GUARD_EXCLUDED = ("OTHER",)

NORMALIZED_ITEM = T.StructType(
    [
        T.StructField("canonical_url", T.StringType()),
        T.StructField("original_url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("timestamp_estimated", T.BooleanType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("image_urls", T.ArrayType(T.StringType())),
    ]
)

"""The corpus pipeline: language, exact copies, near copies, mixing, packing.

Stages take (spark, docs, sf_dir); each is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Rows with null, empty or
blank text have no language and leave at the first stage; rows that repeat, nulls in any
column, very long texts and columns of any name are handled as each operator says; no
rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import exact_dedup, langid, mixing, ngram_join, packing
from tidewire.llm._shared import TEXTS, batch_rows, drop_table, scratch, work_table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: texts without a letter and texts of no learned language go."""
    return langid.drop_unknown(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of texts that are equal without white space, one row stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component of linked documents, the smallest id stays."""
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a row for each copy that the mix takes."""
    return mixing.repeat_by_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row for each piece of a document's copy, with its token ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, draws and packing are beyond SQL; tests compare each stage, and run(), with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; tables that no later stage reads are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch(spark) as keep, batch_rows(spark, TEXTS):
            docs = keep(work_table(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            drop_table(before)
        before = docs
    return docs

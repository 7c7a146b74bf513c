"""Exact duplicates by a content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACES, shuffle_partitions, work_table

#: Characters of the normalised text that lead the sort key; splitters stay this short.
HEAD = 24
#: A text that more than one row in HOT has is sorted in SLICES slices; there are fewer than HOT such texts.
HOT, SLICES = 1024, 64
KEY = ["head", "digest", "slice"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _keyed(rows: DataFrame, norm: Column) -> DataFrame:
    return rows.select("*", norm.alias("norm")).select("*", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("digest"))


def _frequent(keyed: DataFrame) -> DataFrame:
    """Hashes of the texts that get slices, fewer than HOT: all texts are counted."""
    return work_table(keyed.groupBy("digest").count().where(F.col("count") * HOT > keyed.count()).select("digest"), "exact-frequent")


def _slice() -> Column:
    return (F.pmod(F.xxhash64("doc_id", "n_points"), F.lit(SLICES)) + 1).cast("int")


def _order(*key: str) -> Window:
    """Equal texts become neighbours, the one that stays first: the most code points, then the smallest id, null last."""
    return Window.partitionBy(*key).orderBy("norm", F.desc("n_points"), F.asc_nulls_last("doc_id"))


def _leads(order: Window) -> Column:
    """Whether a row's whole text differs from its predecessor's."""
    return ~F.col("norm").eqNullSafe(F.lag("norm").over(order))


def _sorted(dealt: DataFrame, *carried: str) -> DataFrame:
    """The sorted rows, each with its run of equal texts in its slice; the run's first row leads."""
    order = _order(*KEY)  # the range partitioning serves the windows: texts move once
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("leads", _leads(order)).select(
        "doc_id", "n_points", *KEY, "leads", *carried, F.sum(F.col("leads").cast("int")).over(so_far).alias("run"),
        F.when(F.col("leads"), F.sha2("norm", 256)).alias("sha"), F.when(F.col("leads") & (F.col("slice") > 0), F.col("norm")).alias("norm"),
    )


def _met(leaders: DataFrame) -> DataFrame:
    """The leading rows of a frequent text's slices, compared in turn: `first` leads the text's rows of all slices.

    A text has SLICES rows here at most.
    """
    order = _order("head", "digest")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = leaders.withColumn("first", _leads(order))
    return met.select("*", F.sum(F.col("first").cast("int")).over(so_far).alias("text_run")).drop("norm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose texts are equal after white space is deleted.

    Sampled splitters deal the rows out by the start of the normalised text and its hash;
    an external sort puts equal texts next to each other, and a row whose whole text
    equals its predecessor's joins that run. A text that more than one row in HOT has
    is sorted in slices; the first row of each slice's run is then compared with the
    other slices' in the same way. Of a group the row with the most code points stays,
    then the one with the smallest id.

    Returns one row for each input row: doc_id, keep_id, group_size, kept, text_sha256.
    Null text is the empty text; all empty and blank texts are one group. A null id
    comes after all others. Of repeated rows (same id, same text) one is kept. Texts of
    any length are compared whole. Other columns are not read, so their names can't
    clash. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"), F.col(text_col).alias("text"))
    rows = _keyed(rows, normalised(F.col("text"))).drop("text")
    hot = F.broadcast(_frequent(rows).withColumn("hot", F.lit(True)))  # fewer than HOT rows
    rows = rows.join(hot, "digest", "left").withColumn("slice", F.when(F.col("hot"), _slice()).otherwise(0)).drop("hot")
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *KEY)  # splitters are sampled
    same = Window.partitionBy(*KEY, "run")
    leader = F.max(F.when(F.col("leads"), F.struct("doc_id"))).over(same)
    members = _sorted(rows).select(
        "*", leader["doc_id"].alias("keep_id"), F.count("*").over(same).alias("group_size"), F.max("sha").over(same).alias("text_sha256")
    )
    members = work_table(members.drop("sha"), "exact-members")
    done = members.where("slice = 0").select("doc_id", "keep_id", "group_size", F.col("leads").alias("kept"), "text_sha256")
    met = _met(members.where("leads AND slice > 0"))
    text = Window.partitionBy("head", "digest", "text_run")
    met = met.select(
        *KEY, "run", "first", F.sum("group_size").over(text).alias("size"), F.max(F.when(F.col("first"), F.struct("doc_id"))).over(text).alias("keep")
    )
    sliced = members.where("slice > 0").drop("keep_id").join(met, [*KEY, "run"])
    return done.unionByName(
        sliced.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("leads") & F.col("first")).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    The rows themselves are sorted, so what stays is one of them, whatever repeats: ids,
    whole rows, or ids with other texts. Null and empty texts are one group; no rows give
    no rows; columns may have any names.
    """
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col(f"row.{id_col}").alias("doc_id"), F.length(text).alias("n_points"))
    keyed = _keyed(rows, normalised(text)).drop("norm")  # texts move in their rows alone
    hot = _frequent(keyed)
    n = shuffle_partitions(docs.sparkSession)
    cold = keyed.join(F.broadcast(hot), "digest", "left_anti").withColumn("slice", F.lit(0)).repartitionByRange(n, *KEY)
    stay = _sorted(cold.withColumn("norm", normalised(text)), "row").where("leads").select("row.*")
    if hot.isEmpty():
        return stay
    sliced = keyed.join(F.broadcast(hot), "digest", "left_semi").withColumn("slice", _slice()).repartition(n, *KEY)
    leaders = _sorted(sliced.withColumn("norm", normalised(text)), "row").where("leads")
    return stay.unionByName(_met(leaders).where("first").select("row.*"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(x) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY length(x) DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

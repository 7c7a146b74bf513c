"""What each of several filters removes, in every order: a sparse document-term matrix decides, counts are aggregated."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import TEXTS, batch_rows, slices, work_table, work_tables

#: UTF-8 bytes of text from which on a shard is closed.
SHARD_BYTES = 8 << 20
#: Words of a shard that are passed on at once.
WORDS = 100_000
#: The filters by letter; a document's failures are the sum of its filters' bits.
FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"

#: A shard's numbers are packed (see _packed), and its words have rows of their own.
ROWS = "doc_id array<bigint>, part array<string>, fails array<int>, digest array<binary>, indptr binary, data binary, indices binary"
LOCAL = f"shard bigint, at int, word binary, {ROWS}"
CSR = f"shard bigint, {ROWS}"


def _packed(values: np.ndarray) -> bytes:
    """Numbers as steps, 64 bits each, compressed: sorted ones become small."""
    return zstandard.compress(np.diff(values.astype("<i8"), prepend=0).tobytes(), 1)


def _ints(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), "<i8"))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Shard:
    """A run of documents with a dictionary of its own."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.numbers, self.cells, self.counts, self.size = _Numbers(), [], [], 0

    def add(self, doc_id: int | None, part: str, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        words = Counter(raw.split())  # of bytes: at space, tab, LF, VT, FF and CR, as the contract has it
        capitals = len(raw) - len(raw.translate(None, CAPITALS))
        fails = BIT["C"] * (100 * capitals > 3 * len(text)) + BIT["D"] * (len(raw.translate(None, SIGNS)) < len(raw))
        self.rows.append((doc_id, part, fails, hashlib.sha256(raw).digest()))
        cells = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        order = cells.argsort()
        self.cells.append(cells[order])
        self.counts.append(np.fromiter(words.values(), np.int64, len(words))[order])
        self.size += len(raw)

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's words, then its rows."""
        indptr = np.cumsum([0, *map(len, self.cells)])
        packed = [_packed(x) for x in (indptr, np.concatenate(self.counts), np.concatenate(self.cells))]
        types = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary()), *[pa.binary()] * 3]
        words, n = list(self.numbers), len(self.numbers)
        columns = [pa.array(np.full(n, shard)), pa.array(np.arange(n, dtype=np.int32)), pa.array(words, pa.binary()), *(pa.nulls(n, t) for t in types)]
        for a in range(0, n, WORDS):
            yield pa.RecordBatch.from_arrays([c.slice(a, WORDS) for c in columns], names=_names(LOCAL))
        values = [*map(list, zip(*self.rows, strict=True)), *packed]
        columns = [pa.array([shard], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *(pa.array([v], t) for v, t in zip(values, types, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, names=_names(LOCAL))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made, shard = TaskContext.get().partitionId(), 0, _Shard()
    for batch in slices(batches):
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            shard.add(*row)
            if shard.size >= SHARD_BYTES:
                yield from shard.batches(task << 32 | made)
                made, shard = made + 1, _Shard()
    if shard.rows:
        yield from shard.batches(task << 32 | made)


def _global(local: pa.Table, numbers: pa.Table) -> pa.Table:
    """A shard with its words' global numbers."""
    if not local.num_rows:
        return pa.table({name: [] for name in _names(CSR)})
    number = np.zeros(numbers.num_rows, np.int64)
    number[numbers.column("at").to_numpy()] = numbers.column("word_id").to_numpy()
    for name in ("indptr", "data", "indices"):
        values = _ints(local.column(name)[0].as_py())
        values = number[values] if name == "indices" else values
        local = local.set_column(local.column_names.index(name), name, pa.array([values.astype("<i8").tobytes()]))
    return local


class Terms(NamedTuple):
    """The matrix in compressed sparse rows, a row of `shards` for each run of documents, and the dictionary (word, word_id)."""

    shards: DataFrame
    words: DataFrame


def sparse_rows(shard) -> list[tuple]:
    """(doc_id, part, word numbers, counts) of each document of a collected shard."""
    indptr, indices, data = (np.frombuffer(shard[c], "<i8") for c in ("indptr", "indices", "data"))
    return [(i, p, indices[a:b], data[a:b]) for i, p, a, b in zip(shard["doc_id"], shard["part"], indptr, indptr[1:], strict=False)]


def document_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", table=work_table) -> Terms:
    """The sparse document-term matrix of all whole texts, over one dictionary of all words.

    Each task cuts its documents into shards of about SHARD_BYTES (a longer text is one of its own) and
    numbers each shard's words for itself. The words of all shards then meet once: distinct
    ones are numbered from 0 on without gaps, and every shard gets its words' global numbers. So
    what moves is a shard's dictionary, not its text.

    A shard holds, by document, doc_id, part (part_col, null: empty), fails (the bits of filters C and D),
    digest (SHA-256 of the text) and, as usual, indptr, indices (word_id), data (counts): little-endian
    64-bit numbers, which sparse_rows() reads.
    Null text is empty and has an empty row; null and repeated ids have rows of their own; no rows
    give no shard. Other columns are not read.
    """
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint"), part, F.coalesce(F.col(text_col), F.lit("")))
    with batch_rows(docs.sparkSession, TEXTS):
        local = table(rows.mapInArrow(_build, LOCAL), "terms-local")
    own = local.where("word IS NOT NULL").select("shard", "at", "word")
    dealt = table(own.select("word").distinct().select("word", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")), "terms-words")
    ends = dealt.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("_p", "_first", before.alias("_before"))
    words = dealt.join(F.broadcast(ends), "_p").select("word", (F.col("_m") - F.col("_first") + F.col("_before")).alias("word_id"))
    # Either side of the join is dealt by word; a part of the dictionary fits in a hash table, so nothing is sorted.
    numbers = own.join(words.hint("shuffle_hash"), "word").select(F.col("shard").alias("of"), "at", "word_id")
    shards = local.where("word IS NULL").drop("at", "word").groupBy("shard").cogroup(numbers.groupBy("of")).applyInArrow(_global, CSR)
    return Terms(shards, words)


DECIDED = "doc_id bigint, part string, fails int, digest binary, n_words bigint, n_distinct bigint"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            cell = lambda name: batch.column(batch.schema.get_field_index(name)).slice(i, 1).flatten()  # noqa: B023, E731
            indptr, data = (np.frombuffer(batch.column(batch.schema.get_field_index(c))[i].as_py(), "<i8") for c in ("indptr", "data"))
            total = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
            words, distinct = total[indptr[1:]] - total[indptr[:-1]], np.diff(indptr).astype(np.int64)
            fails = cell("fails").to_numpy(zero_copy_only=False) + BIT["A"] * (words < 200) + BIT["B"] * (100 * distinct < 50 * words)
            columns = [cell("doc_id"), cell("part"), pa.array(fails, pa.int32()), cell("digest"), pa.array(words), pa.array(distinct)]
            yield pa.RecordBatch.from_arrays(columns, names=_names(DECIDED))


def decided(terms: Terms) -> DataFrame:
    """(doc_id, part, fails, digest, n_words, n_distinct): row sums and nonzero counts decide filters A and B; E is still open."""
    return terms.shards.mapInArrow(_decide, DECIDED)


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents by all that counts, filter E decided.

    A document fails E if its text's smallest id is smaller than its own. Copies of a text
    are counted by id and then by text before they meet, so a frequent text is a few rows.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    marks = marks.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    by_id = rows.groupBy("digest", "part", "fails", "doc_id").agg(F.count("*").alias("n"))
    by_id = by_id.join(marks, "doc_id", "left").withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    nameless = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0))
    by_text = by_id.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("of_least"), nameless.alias("nameless"))
    least = F.min("least").over(Window.partitionBy("digest"))
    first = F.col("nameless") + F.when(F.col("least") == least, F.col("of_least")).otherwise(0)
    both = F.array(F.struct(F.col("fails"), first.alias("n")), F.struct((F.col("fails") + BIT["E"]).alias("fails"), (F.col("n") - first).alias("n")))
    split = by_text.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", F.inline("x"))
    return split.where("n > 0").groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def _steps() -> Column:
    """All orders of the filters: filter_order, step, the step's bit and those before it."""
    rows = [
        {"filter_order": "".join(o), "step": i + 1, "own": BIT[o[i]], "before": sum(BIT[f] for f in o[:i])}
        for o in permutations(FILTERS)
        for i in range(len(o))
    ]
    return F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,own:int,before:int>>"))


def interactions(cells: DataFrame) -> DataFrame:
    """From cells(): a row for each part, order and step, with what the step's filter does there. At most 128 cells a part."""
    lists = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "good", "toxic", "n")).alias("c"))
    rows = lists.select("part", "c", _steps())
    own, before = F.col("own"), F.col("before")

    def total(test) -> Column:
        return F.aggregate("c", F.lit(0).cast("bigint"), lambda s, c: s + F.when(test(c), c["n"]).otherwise(0))

    fails = lambda c, bits: c["fails"].bitwiseAND(bits) != 0
    here = lambda c: fails(c, own) & ~fails(c, before)
    out = rows.select(
        "part", "filter_order", "step", "own",
        total(lambda c: ~fails(c, own.bitwiseOR(before))).alias("kept"), total(here).alias("removed"), total(lambda c: fails(c, own) & fails(c, before)).alias("redundant"),
        total(lambda c: c["fails"] == own).alias("unique_fails"), total(lambda c: here(c) & c["good"]).alias("good_lost"), total(lambda c: here(c) & c["toxic"]).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Filters A to E in all 120 orders, a row for each part, filter_order and step (1 to 5).

    Fails A: under 200 words; B: fewer than half of the words are distinct; C: more than 3 % of the code points are
    capitals A-Z; D: holds one of #$%&*|; E: equal to the text of a smaller id. Counts: kept, removed,
    redundant (fails, but gone before), unique_fails (fails this filter alone), good_lost, toxic_lost
    (removed here, by labels(doc_id, quality, toxic)), shapley (removed by this filter at any
    step, summed over all orders).

    Null text is empty; null lang is the part ''. Null ids have no order: they never fail E and
    make no other fail. Rows that repeat an id all count, and don't fail E by each other; a
    label that repeats counts if one of its rows says so. Very long texts are taken whole. No rows
    give no rows. Other columns are not read. Tables but for the small one of cells are deleted.
    """
    with work_tables(docs.sparkSession) as table:
        found = table(cells(decided(document_terms(docs, id_col, text_col, part_col, table)), labels), "audit-cells", keep=True)
    return interactions(found)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31
), s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (fails & (own | before) = 0) AS kept, sum(n) FILTER (fails & own <> 0 AND fails & before = 0) AS removed,
    sum(n) FILTER (fails & own <> 0 AND fails & before <> 0) AS redundant, sum(n) FILTER (fails = own) AS unique_fails,
    sum(n) FILTER (fails & own <> 0 AND fails & before = 0 AND good) AS good_lost, sum(n) FILTER (fails & own <> 0 AND fails & before = 0 AND toxic) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM r
"""

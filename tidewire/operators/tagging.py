"""Names of a gazetteer found in whole texts: an automaton in each task, the longest match first."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text

from .graph import cut

#: Names, and code points of all names together, that are broadcast; more are dealt over groups of about so many by their first word.
MOST_NAMES, MOST_CHARS = 500_000, 16 << 20
#: Groups times slices of documents, each with an automaton of its own: so many at least, however few groups there are. Documents whose mentions are sent at a time.
CELLS, SENT = 128, 500
FOUND = "entity_id bigint, start int, words int"


def keyed(names: DataFrame) -> DataFrame:
    """(entity_id, key, first) of names(entity_id, name): words between spaces. Of names with equal words the smallest id stands; names without words go."""
    words = text.tokens(F.col("name"))
    rows = names.where("entity_id IS NOT NULL AND name IS NOT NULL").select("entity_id", words.alias("w")).where(F.size("w") > 0)
    key = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    return rows.select("entity_id", key.alias("key"), F.get("w", F.lit(0)).alias("first")).groupBy("key", "first").agg(F.min("entity_id").alias("entity_id"))


def automaton(keys: list[str], ids: list[int]):
    out = ahocorasick.Automaton()
    for key, i in zip(keys, ids, strict=True):
        out.add_word(key, (i, key.count(" ") - 1))
    out.make_automaton()
    return out


def matches(machine, words: str) -> list[tuple[int, int, int]]:
    """(start, words, entity) of all names in words between single spaces, overlapping ones too."""
    if not words or not len(machine):
        return []
    line, out, n, last = " " + words + " ", [], 0, 0
    for end, (i, size) in machine.iter(line):  # by their ends, so each space is counted once
        n, last = n + line.count(" ", last, end), end
        out.append((n - size, size, i))
    return out


def longest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """From left to right the longest match at each place, none over another."""
    out, free = [], 0
    for start, n, i in sorted(found, key=lambda m: (m[0], -m[1])):
        if start >= free:
            out.append((start, n, i))
            free = start + n
    return out


def _columns(found: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, list[pa.Array]]:
    """How many matches each document has, and all starts, words and entities one after another."""
    flat = np.array([m for doc in found for m in doc], np.int64).reshape(-1, 3)
    return np.array([len(doc) for doc in found], np.int64), [pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2])]


def _mentions(ids: pa.Array, found: list[list[tuple[int, int, int]]], times: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each match, for all of a document's as often as `times` says."""
    if times is not None:
        found = [doc * n for doc, n in zip(found, times.tolist(), strict=True)]
    sizes, (start, words, entity) = _columns(found)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), sizes))), entity, start, words], names=["id", "entity_id", "start", "words"])


def _with_all(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, SENT):
                some = batch.slice(a, SENT)
                yield _mentions(some.column("id"), [longest(matches(machine, w)) for w in some.column("w").to_pylist()])

    return run


def _longest_here(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the matches that start at one word the longest: no other can count."""
    return list({m[0]: m for m in sorted(found)}.values())


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each cell's names, then its documents, in one stream: (id, of, row, times, start, words, entity) for each document with matches."""
    machine, ready, cell = None, False, None
    for batch in batches:
        cells, named = batch.column("cell").to_numpy(), batch.column("entity_id").is_valid().to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero((cells[1:] != cells[:-1]) | (named[1:] != named[:-1])) + 1, len(cells)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a < b and cells[a] != cell:
                machine, ready, cell = ahocorasick.Automaton(), False, cells[a]
            if a < b and named[a]:
                some = batch.slice(a, b - a)
                for key, i in zip(some.column("key").to_pylist(), some.column("entity_id").to_pylist(), strict=True):
                    machine.add_word(key, (i, key.count(" ") - 1))
                continue
            if not ready and len(machine or ()):
                machine.make_automaton()
            ready = True
            for at in range(a, b, SENT):
                some = batch.slice(at, min(SENT, b - at))
                found = [_longest_here(matches(machine, w)) for w in some.column("w").to_pylist()]
                sizes, columns = _columns(found)
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, c) for c in columns]
                out = pa.RecordBatch.from_arrays([*(some.column(c) for c in ("id", "of", "row", "times")), *lists], names=["id", "of", "row", "times", "start", "words", "entity"])
                yield out.filter(pa.array(sizes > 0))


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' matches of all groups, rows sorted by (of, row), as mentions."""
    rest: list[tuple] = []  # of the last document, which may go on in the next batch
    for batch in batches:
        kind, docs = batch.column("id").type, []
        for r in [*zip(*(batch.column(c).to_pylist() for c in ("of", "row", "id", "times", "start", "words", "entity")), strict=True)]:
            if rest and rest[0][:2] != r[:2]:
                docs.append(rest)
                rest = []
            rest.append(r)
        yield from _whole(docs, kind)
    if rest:
        yield from _whole([rest], kind)


def _whole(docs: list[list[tuple]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(docs), SENT):
        some = docs[a : a + SENT]
        found = [longest([m for r in rows for m in zip(*r[4:], strict=True)]) for rows in some]
        yield _mentions(pa.array([rows[0][2] for rows in some], kind), found, np.array([rows[0][3] for rows in some]))


def mentions(docs: DataFrame, names: DataFrame, most_names: int = MOST_NAMES, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, entity_id, start, words): where docs(id, text) say names(entity_id, name), as word numbers from 0.

    Words are runs of a-z, 0-9 and ' in lower case. From left to right the longest name at each place counts, and
    none over another. As long as the names are `most_names` and `most_chars` at most, which is counted first, every
    task has the whole automaton; beyond, names are dealt over groups by their first word, a document goes
    to the groups of its words only, and a document's matches meet again. Few groups would be few tasks, so each has its names
    in several slices of the documents; all slices together hold about CELLS times `most_names` names at most, or each name once. Null and empty texts
    have no mentions; rows that repeat an id are found in each for itself; no rows give no rows.
    """
    keys = cut(keyed(names).select("key", "first", "entity_id"))  # counted, then sent
    size = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("chars")).first()
    line = F.array_join("w", " ").alias("w")  # one string, where a list of words takes many times as much in Python
    rows = docs.select("id", text.tokens(F.coalesce("text", F.lit(""))).alias("w")).select("id", line)
    kind = docs.schema["id"].dataType.simpleString()
    if size["n"] <= most_names and size["chars"] <= most_chars:
        got = keys.toPandas()
        shared = docs.sparkSession.sparkContext.broadcast((got["key"].tolist(), got["entity_id"].tolist()))  # counted above
        return rows.mapInArrow(_with_all(shared), f"id {kind}, {FOUND}")
    groups = int(max(-(-size["n"] // max(1, most_names)), -(-size["chars"] // max(1, most_chars))))
    slices = max(1, -(-CELLS // groups))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)) * slices
    none = {"entity_id": F.lit(None).cast("bigint"), "key": F.lit(None).cast("string")}
    # Equal rows go once, with their number.
    rows = docs.groupBy("id", F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("times"))
    rows = rows.select("id", F.xxhash64("id").alias("of"), F.xxhash64("text").alias("row"), "times", text.tokens(F.col("text")).alias("w"))
    own = F.pmod(F.xxhash64("of", "row"), F.lit(slices))
    asked = rows.select("id", "of", "row", "times", line, F.explode(F.array_distinct(F.transform("w", group))).alias("group")).select((F.col("group") + own).alias("cell"), "id", "of", "row", "times", "w")
    empty = [F.lit(None).cast(c).alias(n) for n, c in (("id", kind), ("of", "bigint"), ("row", "bigint"), ("times", "bigint"), ("w", "string"))]
    known = keys.select("entity_id", "key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda x: group(F.col("first")) + x)).alias("cell"), *empty)
    both = known.unionByName(asked.withColumns(none)).repartition("cell").sortWithinPartitions("cell", F.asc_nulls_last("entity_id"))
    lists = "start array<int>, words array<int>, entity array<bigint>"
    found = both.mapInArrow(_by_cell, f"id {kind}, of bigint, row bigint, times bigint, {lists}")
    return found.repartition("of", "row").sortWithinPartitions("of", "row").mapInArrow(_resolved, f"id {kind}, {FOUND}")


def counts(found: DataFrame) -> DataFrame:
    """(id, entity_id, mention_count, first) of mentions."""
    return found.groupBy("id", "entity_id").agg(F.count("*").alias("mention_count"), F.min("start").alias("first"))

"""Document fingerprints from closed syncmers: anchors that only their own letters choose, matched in text order."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import TEXTS, shuffle_partitions, slices

#: Code points of an anchor and of its inner substrings; those of the further anchors of texts shorter than a length.
K, S = 16, 5
SHORT = ((128, 6, 2), (24, 2, 1))
#: Anchors that a fingerprint keeps; bytes of a kept anchor.
SIZE, BYTES = 64, 5
#: Places of a text that are hashed at once, and code points of the texts that are.
CHUNK, AT_ONCE = 1 << 19, 1 << 22


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Odd multipliers of a substring's code points and of an anchor's substrings.
_ODD = _mixed(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)


def _inner(codes: np.ndarray, s: int) -> np.ndarray:
    """A hash of each substring of s code points."""
    n = len(codes) - s + 1
    h = codes[:n] * _ODD[0]
    for j in range(1, s):
        h += codes[j : n + j] * _ODD[j]
    return _mixed(h)


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """The least of each `window` neighbours, by doubling."""
    have, span = h, 1
    while span < window:
        step = min(span, window - span)
        have = np.minimum(have[:-step], have[step:])
        span += step
    return have


def syncmers(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of a run of code points.

    A run of k code points is one if its least inner substring (by hash, s code points) is its
    first or its last. Nothing around it matters, so an edit changes the anchors that it touches
    only, and any k - s neighbouring runs hold at least one.
    """
    window = k - s + 1
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a in range(0, max(0, len(codes) - k + 1), CHUNK):
        h = _inner(codes[a : a + CHUNK + k - 1].astype(np.uint64), s)
        low = _least(h, window)
        found = np.flatnonzero((h[: len(low)] == low) | (h[window - 1 :] == low))
        # Substrings at 0, s, 2s, ... and the last one cover the anchor.
        parts = [*range(0, window - 1, s), window - 1]
        at.append(found + a)
        hashes.append(_mixed(sum(h[found + p] * _ODD[k + i] for i, p in enumerate(parts))))
    return np.concatenate(at), np.concatenate(hashes)


def _whole(text: str) -> int:
    """The one anchor of a text without a syncmer: the text itself."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def anchors(texts: list[str]) -> list[np.ndarray]:
    """For each text the SIZE least hashes of its anchors, in the order in which the text has them."""
    out: list[np.ndarray] = []
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= AT_ONCE):
            size += len(texts[end])
            end += 1
        out += _anchors(texts[start:end])
        start = end
    return out


def _inside(texts: list[str], ids: list[int], k: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of the anchors of some texts; what lies across two texts is left out."""
    ends = np.cumsum([len(texts[i]) for i in ids])
    at, h = syncmers(_codes("".join(texts[i] for i in ids)), k, s)
    of = np.searchsorted(ends, at, side="right")
    inside = at + k <= ends[of] if len(at) else np.zeros(0, bool)
    at, of, h = at[inside], of[inside], h[inside]
    return np.array(ids, np.int64)[of], at - (ends[of] - np.array([len(texts[i]) for i in ids])[of]) if len(at) else at, h


def _anchors(texts: list[str]) -> list[np.ndarray]:
    """anchors() of texts that are hashed together; short texts have anchors of several lengths."""
    found = [_inside(texts, list(range(len(texts))), K, S)]
    for under, k, s in SHORT:
        if few := [i for i, t in enumerate(texts) if len(t) < under]:
            found.append(_inside(texts, few, k, s))
    of, at, h = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((at, h, of))
    at, of, h = at[order], of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    # The second time that a text has an anchor is another anchor, and so on: repeats count.
    first = np.flatnonzero(new)
    times = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    h = _mixed(h + times.astype(np.uint64) * _ODD[0]) >> np.uint64(64 - 8 * BYTES)
    order = np.lexsort((at, h, of))
    at, of, h = at[order], of[order], h[order]
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])  # the first of hashes that agree in BYTES
    at, of, h = at[new], of[new], h[new]
    lo, hi = np.searchsorted(of, [np.arange(len(texts)), np.arange(1, len(texts) + 1)])
    out = []
    for i, t in enumerate(texts):
        a, b = lo[i], min(hi[i], lo[i] + SIZE)
        if a < b:
            out.append(h[a:b][np.argsort(at[a:b])])
        else:
            out.append(np.array([_whole(t) >> (64 - 8 * BYTES)] if t else [], dtype=np.uint64))
    return out


def packed(hashes: np.ndarray) -> str:
    """A fingerprint: the kept anchors' hashes in text order, BYTES each, in base64 without padding."""
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()
    return base64.b64encode(raw).decode().rstrip("=")


def unpacked(fingerprint: str) -> list[int]:
    raw = base64.b64decode(fingerprint + "=" * (-len(fingerprint) % 4))
    return [int.from_bytes(raw[i : i + BYTES], "little") for i in range(0, len(raw), BYTES)]


def likeness(a: list[int], b: list[int]) -> float:
    """The share of two texts' anchors that both have, in one order: from 0 to 1, 1 if both are empty.

    Of the SIZE least anchors of both together, those in common are lined up by their places
    in the first text; the longest run that rises in the second one counts. Texts of fewer than
    SIZE anchors each are compared by all of them.
    """
    if a == b:
        return 1.0
    place = {h: i for i, h in enumerate(b)}
    union = sorted({*a, *b})[: SIZE if SIZE in (len(a), len(b)) else None]
    if not union:
        return 1.0
    last = union[-1]
    tails: list[int] = []
    for h in a:
        i = place.get(h) if h <= last else None
        if i is not None:
            j = bisect_left(tails, i)
            tails[j : j + 1] = [i]
    return len(tails) / len(union)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; null is empty, an empty text has an empty fingerprint.

    Rows stand for themselves, so null ids, ties and repeated rows change nothing; very long
    texts are hashed in pieces; no rows give no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(map(packed, anchors(texts)), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def _parts(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """rows with `part`, a range of ids each, and the ranges' lower ends: at most a number for each shuffle partition."""
    n = shuffle_partitions(rows.sparkSession)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts), ids.to_numpy(), side="right"))

    if not cuts:
        return rows.withColumn("part", F.lit(0)), cuts
    return rows.withColumn("part", F.coalesce(part(F.coalesce("doc_id", F.lit(-(2**63)))), F.lit(0))), cuts


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, follows, doc_id, text): rows dealt by ranges of ids and sorted, so that each row's next one is behind it.

    The order is by id, null first, then by text. Behind each range's rows comes a copy of
    the next range's first row (`follows`), behind the last range's of the first. Ids alone find
    the ranges' ends; each text moves once.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, _ = _parts(rows)
    # A row for each range: its first id, and the range before it.
    heads = sorted(rows.select("part", "doc_id").groupBy("part").agg(F.min("doc_id").alias("first"), F.bool_or(F.col("doc_id").isNull()).alias("none")).collect())
    if not heads:
        return rows.select("part", F.lit(False).alias("follows"), "doc_id", "text")
    ends = [(heads[i - 1]["part"], h["part"], None if h["none"] else h["first"]) for i, h in enumerate(heads)]
    follow = docs.sparkSession.createDataFrame(ends, "before int, at int, id bigint")
    first = rows.join(F.broadcast(follow), (F.col("part") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("id")))  # a row for each range
    first = first.groupBy("before", "doc_id").agg(F.min("text").alias("text")).select(F.col("before").alias("part"), F.lit(True).alias("follows"), "doc_id", "text")
    both = rows.select("part", F.lit(False).alias("follows"), "doc_id", "text").unionByName(first)
    return both.repartition("part").sortWithinPartitions("part", "follows", F.asc_nulls_first("doc_id"), "text")


def edited(text: str, after: str) -> str:
    """The text whose last half is replaced by the first part, as long or all, of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of sorted ranges against its edited text and its next row; rows that only follow give none."""
    held = None  # the row before this batch: part, follows, id, text, anchors
    for batch in slices(batches, TEXTS):
        part, follows, ids, texts = (batch.column(i).to_pylist() for i in range(4))
        rows = ([held] if held else []) + list(zip(part, follows, ids, texts, anchors(texts), strict=True))
        held = rows[-1]
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]  # noqa: B905
        changed = [edited(a[3], b[3]) for a, b in pairs]
        out: list[list] = [[] for _ in range(7)]
        for (a, b), text, found in zip(pairs, changed, anchors(changed), strict=True):
            own = a[4].tolist()
            values = (a[2], len(a[3]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), packed(a[4]), packed(found), likeness(own, found.tolist()), likeness(own, b[4].tolist()))
            for column, v in zip(out, values, strict=True):
                column.append(v)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How each text's fingerprint is like that of its edited text and of the next document.

    The edited text is a text whose last half is the next document's first. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next
    document is the one with the next larger id, null ids before all others, rows of one id
    in the order of their texts, equal rows one after another; after the last comes the first, and a
    lone row follows itself. Null text is empty; two empty fingerprints are alike (1), an empty
    one and another are not (0). Very long texts are taken whole; no rows give no rows.
    Other columns are not read.
    """
    return with_next(docs, id_col, text_col).mapInArrow(_compare, OUT)

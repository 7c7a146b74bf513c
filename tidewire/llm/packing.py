"""Pack token sequences: best fit in each task, then a tree of rounds over underfull bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import TEXTS, batch_rows, drop_table, slices, work_table

SIZE = 2048
#: A bin with at most so many free places is final.
NEARLY = 8
#: Pieces that one local best fit takes, and bins that one task of a later round takes.
BLOCK = 8192
#: Tasks of a round whose underfull bins meet in one task of the next.
FAN_IN = 8

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
BIN = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int32()), ("members", pa.list_(MEMBER))])
BIN_DDL = "sequence_id bigint, fill int, members array<struct<doc_id:bigint,piece:int,start:bigint,offset:bigint,ids:binary>>"

_loaded: dict = {}


def _encoder(ranks_path: str):
    if ranks_path not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[ranks_path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[ranks_path]


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def token_ids(text: str, tokenizer_path: str, ranks_path: str | None = None) -> np.ndarray:
    """The ids that the tokenizer file gives, as little-endian uint32.

    ranks_path names the same vocabulary as byte ranks; it gives the same ids in a
    quarter of the time. A text with a special token's string goes to the tokenizer.
    """
    if ranks_path and "<|" not in text:
        return _encoder(ranks_path).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.array(_tokenizer(tokenizer_path).encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """Bounds of the pieces of n tokens: a shorter first one, then whole ones."""
    first = n % size
    return ([(0, first)] if first else []) + [(a, a + size) for a in range(first, n, size)]


def best_fit(lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Best fit by decreasing length; a mask of the free sizes in use finds the tightest bin."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if above := mask >> n:
            room = n + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
        else:
            b, room = len(bins), size
            bins.append([i])
        if left := room - n:
            free.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def _batch(bins: list[list[tuple]], ids: Iterator[int]) -> pa.RecordBatch:
    """bins: lists of (doc_id, piece, start, tokens), laid out one after the other."""
    flat = [m for b in bins for m in b]
    lengths = np.array([len(m[3]) // 4 for m in flat], dtype=np.int64)
    ends = np.cumsum([0, *map(len, bins)])
    total = np.concatenate([[0], np.cumsum(lengths)])
    begin = np.repeat(total[ends[:-1]], np.diff(ends))
    members = pa.StructArray.from_arrays(
        [
            pa.array([m[0] for m in flat], pa.int64()),
            pa.array([m[1] for m in flat], pa.int32()),
            pa.array([m[2] for m in flat], pa.int64()),
            pa.array(total[:-1] - begin, pa.int64()),
            pa.array([m[3] for m in flat], pa.binary()),
        ],
        fields=list(MEMBER),
    )
    fill = (total[ends[1:]] - total[ends[:-1]]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([next(ids) for _ in bins], pa.int64()), pa.array(fill), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members)], schema=BIN)


def _numbers(level: int) -> Iterator[int]:
    """Sequence numbers that no other task and round gives."""
    n = (level << 57) | (TaskContext.get().partitionId() << 32)
    while True:
        yield n
        n += 1


def _first_round(size: int, tokenizer_path: str, ranks_path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _numbers(0)
        block: list[tuple] = []
        for batch in slices(batches):
            whole: list[list[tuple]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.append(token_ids(text, tokenizer_path, ranks_path), np.array([end_id], "<u4"))
                for piece, (a, b) in enumerate(cuts(len(tokens), size)):
                    one = (doc_id, piece, a, tokens[a:b].tobytes())
                    if b - a == size:
                        whole.append([one])
                    else:
                        block.append(one)
            if whole:
                yield _batch(whole, ids)
            if len(block) >= BLOCK:
                yield _batch([[block[i] for i in b] for b in best_fit([len(m[3]) // 4 for m in block], size)], ids)
                block = []
        if block:
            yield _batch([[block[i] for i in b] for b in best_fit([len(m[3]) // 4 for m in block], size)], ids)

    return run


def _next_round(level: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _numbers(level)
        items: list[list[tuple]] = []
        fills: list[int] = []

        def pack() -> pa.RecordBatch:
            return _batch([[m for i in b for m in items[i]] for b in best_fit(fills, size)], ids)

        for batch in slices(batches):
            for fill, members in zip(batch.column("fill").to_pylist(), batch.column("members").to_pylist(), strict=True):
                items.append([(m["doc_id"], m["piece"], m["start"], m["ids"]) for m in members])
                fills.append(fill)
            if len(items) >= 2 * BLOCK:
                yield pack()
                items, fills = [], []
        if items:
            yield pack()

    return run


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 0,
    tokenizer_path: str | None = None, ranks_path: str | None = None,
) -> DataFrame:
    """Pack every document's tokens and end_id into as few sequences of size tokens as it can.

    Tokenizing tasks best-fit their own pieces in blocks; bins with at most NEARLY free
    places are final. The underfull ones travel on as items: a round deals them to an
    eighth of the tasks and best-fits them again, until one task is left, or until bins
    that fit no more are too many for it and no round merges a hundredth of them.

    Only documents of more than size tokens are cut, into whole pieces behind a shorter
    first one. Returns one row for each piece: doc_id, piece, start, length, ids (binary,
    little-endian uint32), sequence_id, offset. Null and empty texts are one end_id; null
    ids and repeated rows are packed like others; no rows give no rows. Other columns are
    not read. Tokenizer paths default to the installed byte_bpe_50k.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with batch_rows(docs.sparkSession, TEXTS):
        made = work_table(rows.mapInArrow(_first_round(size, str(tokenizer_path), ranks_path and str(ranks_path), end_id), BIN_DDL), "pack-level0")
    final = made.where(F.col("fill") >= size - NEARLY)
    rest = made.where(F.col("fill") < size - NEARLY)
    left, level, tasks = rest.count(), 0, made.rdd.getNumPartitions()
    while left:
        level += 1
        tasks = max(1, -(-tasks // FAN_IN), -(-left // BLOCK))
        made = work_table(rest.repartition(tasks).mapInArrow(_next_round(level, size), BIN_DDL), f"pack-level{level}")
        rest = made.where(F.col("fill") < size - NEARLY)
        before, left = left, rest.count()
        if tasks == 1 or level > 30 or (left > BLOCK and left > 0.99 * before):
            final = final.unionByName(made)
            break
        final = final.unionByName(made.where(F.col("fill") >= size - NEARLY))
    m = F.col("m")
    return final.select("sequence_id", F.explode("members").alias("m")).select(
        m["doc_id"].alias("doc_id"), m["piece"].alias("piece"), m["start"].alias("start"),
        (F.octet_length(m["ids"]) / 4).cast("bigint").alias("length"), m["ids"].alias("ids"), "sequence_id", m["offset"].alias("offset"),
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

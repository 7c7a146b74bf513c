"""Jaccard join of word shingles: prefix blocks, signature trees, link components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import TEXTS, batch_rows, drop_table, shuffle_partitions, slices, work_tables

#: Words of a shingle; a link needs 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Places of the frequency sketch, rows it travels in, and places of the id filter: fixed, whatever the input.
SLOTS, ROWS, BITS = 1 << 20, 64, 1 << 23
#: Sketches that are added up in one group; sums of groups are added up in the same way.
LANES = 64
#: Documents that one signature tree holds, and children of a node.
LEAVES, FAN_OUT = 512, 8
#: Rows of hashes in an Arrow batch, and bytes of text hashed at once.
ROWS_A_BATCH = 10_000
STEP = 1 << 19
#: A prefix is longer than one shared hash asks for by this part of the set: then linked sets share many.
SHARE = 8
#: A hash of more than one in HOT rows is split over SALTS tasks; there are fewer than HOT of them.
HOT, SALTS = 1024, 64

U = np.uint64
_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_AT = _RNG.integers(1, 2**63, WORDS + 1, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; a batch is hashed at once.

    A word's hash sums a number for each of its bytes, which mixes the byte with its place in the
    word, so words of any structure differ; a shingle's mixes those of its words. A text of fewer words than a shingle is one
    shingle; one without words has none.
    """
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return []
    if n > 1 and texts.nbytes > STEP:  # the running sums take 40 bytes a byte
        return shingle_sets(texts[: n // 2]) + shingle_sets(texts[n // 2 :])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    empty = np.zeros(0, np.uint64)
    if not len(data):
        return [empty] * n
    space = _SPACE[data]
    edge = np.empty(len(data), dtype=bool)  # a word starts: no space, and a space or another text before
    edge[0] = True
    edge[1:] = space[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge & ~space)
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    last[:-1] = space[1:]
    inner = offsets[1:-1]
    last[inner[(inner > 0)] - 1] = True
    ends = np.flatnonzero(last & ~space) + 1
    place = np.arange(len(data))
    place -= np.maximum.accumulate(np.where(edge & ~space, place, 0))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_mix(_BYTE[data] + place.astype(np.uint64) * U(_BASE)), out=sums[1:])
    words = _mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets[:-1])
    until = np.append(first[1:], len(starts))
    m = max(0, len(words) - WORDS + 1)
    whole = np.zeros(m, dtype=np.uint64)
    for j in range(WORDS):
        whole += words[j : j + m] * _AT[j]
    whole = _mix(whole)
    out = []
    for a, b in zip(first.tolist(), until.tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(whole[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * _AT[: b - a]).sum(dtype=np.uint64, keepdims=True) + _AT[WORDS:] * U(b - a)))
        else:
            out.append(empty)
    return out


def prefix(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The hashes of a set, rare ones first, of which a linked set holds a share.

    Of a set of n, the first n - need + n / SHARE in an order of all hashes, need = 0.75 n.
    The common hashes of linked sets are need of each at least, so of two such prefixes
    they share as many as the smaller extra: the k-th common hash has need - k behind it.
    """
    need = (PERCENT * len(s) + 99) // 100
    order = np.lexsort((s, level[(s & U(SLOTS - 1)).astype(np.int64)]))
    return s[order[: len(s) - need + max(1, len(s) // SHARE)]]


def least_shared(n: Column) -> Column:
    """Hashes of its prefix that a set of n shares with any linked one: the extra of the smallest such set."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * PERCENT / 100) / SHARE))


# -- the frequency sketch: how often the shingles of each place occur, over all documents


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, dtype=np.int64)
    for batch in slices(batches):
        if sets := shingle_sets(batch.column(0)):
            total += np.bincount((np.concatenate(sets) & U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    if total.any():
        part = [p.astype(np.uint32).tobytes() for p in np.split(np.minimum(total, 2**32 - 1), ROWS)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ROWS), pa.int32()), pa.array([task // LANES] * ROWS, pa.int32()), pa.array(part, pa.binary())], names=["part", "lane", "counts"])


def _add_up(rows: pa.Table) -> pa.Table:
    total = np.zeros(SLOTS // ROWS, dtype=np.uint64)
    for c in rows.column("counts"):
        total += np.frombuffer(c.as_py(), dtype=np.uint32)
    one = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()
    return pa.table([rows.column("part")[:1], rows.column("lane")[:1], pa.array([one], pa.binary())], names=["part", "lane", "counts"])


def frequency_levels(texts: DataFrame) -> np.ndarray:
    """For each place 0, or by how many powers of two its shingles are more frequent than most."""
    ddl = "part int, lane int, counts binary"
    sums = texts.select("text").mapInArrow(_count_slots, ddl)
    for _ in range(2):  # LANES ** 3 tasks leave groups of LANES
        sums = sums.groupBy("part", "lane").applyInArrow(_add_up, ddl).withColumn("lane", F.floor(F.col("lane") / LANES).cast("int"))
    sums = sums.groupBy("part").applyInArrow(_add_up, ddl)
    count = np.zeros((ROWS, SLOTS // ROWS))
    for row in sums.collect():  # ROWS rows of a fixed size
        count[row["part"]] = np.frombuffer(row["counts"], dtype=np.uint32)
    usual = 2 * count.mean() + 4
    return np.floor(np.log2(np.maximum(count.ravel() / usual, 0.5))).astype(np.int8) + 1


# -- classes of equal sets, and the blocks in which linked classes meet


#: Classes that a task remembers, to write the prefix of a class seldom more than once.
SEEN = 1 << 20


def _digest(s: np.ndarray, salt: int) -> tuple[int, int]:
    """A set's class, and a number that sets of one class must have in common."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(16, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _class_batches(shared, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shared.value, set()
        for batch in slices(batches):
            n, cid, twin, heads = [], [], [], []
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                c, t = _digest(s, salt) if len(s) else (None, None)
                n.append(len(s))
                cid.append(c)
                twin.append(t)
                new = c is not None and i is not None and c not in seen
                heads.append(prefix(s, level).view(np.int64) if new else None)
                if new:
                    seen.add(c)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(cid, pa.int64()), pa.array(twin, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], names=["doc_id", "n", "cid", "twin", "prefix"])

    return run


def _shared_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (hash, cid, n, weight) in order of hash and cid: those whose hash two classes have.

    Each has the number of those classes, and as head the one of the largest weight. The
    first and last hash of a range may go on in the next: they stay, and `cut` marks them.
    """
    names = ["hash", "cid", "n", "size", "head", "cut"]
    held: list[np.ndarray] | None = None
    first = True

    def runs(cols: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        """What whole runs of one hash give, and the last run, which may go on."""
        h, cid, n, weight = cols
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        end = len(h) if last else at[-1]
        size = np.diff(np.append(at, len(h)))
        most = np.repeat(np.maximum.reduceat(weight, at), size)
        head = cid[np.minimum.reduceat(np.where(weight == most, np.arange(len(h)), len(h)), at)]
        cut = np.zeros(len(at), dtype=bool)
        cut[0], cut[-1] = first, last
        keep = np.repeat((size > 1) | cut, size)[:end]
        per_run = [np.repeat(x, size)[:end] for x in (size.astype(np.int32), head, cut)]
        out = [pa.array(x[keep]) for x in (h[:end], cid[:end], n[:end], *per_run)]
        return pa.RecordBatch.from_arrays(out, names=names), [c[end:] for c in cols]

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy() for c in batch.columns]
        held = [np.concatenate(c) for c in zip(held, now, strict=True)] if held else now
        fresh = np.append(True, (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        held = [c[fresh] for c in held]
        if held[0][0] != held[0][-1]:
            out, held = runs(held, False)
            first = False
            yield out
    if held:
        yield runs(held, True)[0]


SHARED_DDL = "hash bigint, cid bigint, n int, size int, head bigint, cut boolean"


def shared_by_range(rows: DataFrame, n: int) -> DataFrame:
    """Rows (hash, cid, n) whose hash two classes have, with the head of each; a frequent hash is split over ranges."""
    return rows.repartitionByRange(n, "hash", "cid").sortWithinPartitions("hash", "cid").mapInArrow(_shared_hashes, SHARED_DDL)


def enough_shared(shared: DataFrame) -> DataFrame:
    """Rows (hash, cid, n, weight) of the classes that share enough hashes with all others together to link with one.

    A class weighs the more, the more classes share its hashes: the text that many copies
    were made from leads them.
    """
    own = Window.partitionBy("cid")  # a class has the rows of its own prefix
    shares, weight = F.count("*").over(own), (8 * F.avg("size").over(own)).cast("int")
    rows = shared.select("hash", "cid", "n", shares.alias("shares"), weight.alias("weight"))
    return rows.where(F.col("shares") >= least_shared(F.col("n"))).drop("shares")


def components(edges: DataFrame, table, name: str = "cc") -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots; a root is its part's smallest node.

    Each node hooks onto its smallest smaller neighbour, the hooks are flattened by pointer
    jumping, and edges between the trees go on, until none is left.
    """
    e = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    e = table(e, f"{name}-edges")
    maps = []
    while not e.isEmpty():
        hooks = table(e.groupBy("hi").agg(F.min("lo").alias("root")), f"{name}-hooks")
        while True:
            up = hooks.select(F.col("hi").alias("via"), F.col("root").alias("above"))
            jumped = hooks.join(up, hooks["root"] == up["via"], "left")
            jumped = table(jumped.select("hi", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), f"{name}-jump")
            hooks = jumped.select("hi", "root")
            if jumped.where("moved").isEmpty():
                break
        maps.append(hooks)
        a, b = hooks.toDF("node_a", "root_a"), hooks.toDF("node_b", "root_b")
        moved = e.join(a, e["lo"] == a["node_a"], "left").join(b, e["hi"] == b["node_b"], "left")
        moved = moved.select(F.coalesce("root_a", "lo").alias("a"), F.coalesce("root_b", "hi").alias("b"))
        e = table(moved.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), f"{name}-edges")
    if not maps:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        up = out.select(F.col("hi").alias("via"), F.col("root").alias("above"))
        out = m.join(up, m["root"] == up["via"], "left").select("hi", F.coalesce("above", "root").alias("root")).unionByName(out)
    return table(out.select(F.col("hi").alias("node"), "root"), f"{name}-roots")


# -- signature trees


class Forest:
    """Union-find whose root is the smallest index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.find(i), self.find(j)))
        self.up[b] = a


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


class SignatureTree:
    """Sets by size; a node holds the OR of its sets' bitmaps, its size range and its largest slack.

    A bitmap has a bit for each hash value modulo its width; slack is a set's size less its
    bits. Sets A under one node and B under another share at most min(|A|, |B|) hashes, and
    at most slack(A) + the bits that both nodes have.
    """

    def __init__(self, sets: list[np.ndarray], width: int = 0):
        sizes = np.array([len(s) for s in sets])
        width = self.width = width or min(8192, max(64, 1 << int(2 * np.median(sizes)).bit_length()))
        bits = np.zeros((len(sets), width // 64), dtype=np.uint64)
        rows = np.repeat(np.arange(len(sets)), sizes)
        places = np.concatenate(sets) % U(width)
        np.bitwise_or.at(bits, (rows, (places >> U(6)).astype(np.int64)), U(1) << (places & U(63)))
        slack = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.sets = sets
        self.levels = [(bits, sizes, sizes, slack)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, sl = self.levels[-1]
            at = np.arange(0, len(lo), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)))

    def _may_link(self, level: int, i: np.ndarray, other: SignatureTree, level_b: int, j: np.ndarray) -> np.ndarray:
        bits, lo, hi, slack = self.levels[level]
        bits_b, lo_b, hi_b, slack_b = other.levels[level_b]
        a, b = np.meshgrid(i, j, indexing="ij")
        common = np.bitwise_count(bits[a] & bits_b[b]).sum(axis=2).astype(np.int64)
        most = np.minimum(np.minimum(hi[a], hi_b[b]), common + np.minimum(slack[a], slack_b[b]))
        # inter >= p (|A| + |B| - inter) with p = PERCENT / 100; the sizes are the nodes' least
        fits = (100 + PERCENT) * most >= PERCENT * (lo[a] + lo_b[b])
        near = (100 * hi[a] >= PERCENT * lo_b[b]) & (100 * hi_b[b] >= PERCENT * lo[a])
        return fits & near

    def _below(self, level: int, x: int) -> np.ndarray:
        """Children of a node, or the set itself."""
        if level == 0:
            return np.array([x])
        return np.arange(x * FAN_OUT, min(len(self.levels[level - 1][1]), (x + 1) * FAN_OUT))

    def links(self, other: SignatureTree, apart) -> Iterator[tuple[int, int]]:
        """Linked pairs of this tree's sets and another's, of those that apart(x, y) still wants compared."""
        todo = [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while todo:
            level, x, level_b, y = todo.pop()
            if level == level_b == 0:
                if apart(x, y) and linked(self.sets[x], other.sets[y]):
                    yield x, y
                continue
            i, j = self._below(level, x), other._below(level_b, y)
            down, down_b = max(0, level - 1), max(0, level_b - 1)
            for a, b in zip(*np.nonzero(self._may_link(down, i, other, down_b, j)), strict=True):
                if down or down_b or apart(int(i[a]), int(j[b])):
                    todo.append((down, int(i[a]), down_b, int(j[b])))

    def join(self, forest: Forest) -> None:
        """Dual traversal from the root pair; pairs that can't link, or are in one part already, end there."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, x, y = todo.pop()
            if level == 0:
                if x != y and forest.find(x) != forest.find(y) and linked(self.sets[x], self.sets[y]):
                    forest.join(x, y)
                continue
            below = len(self.levels[level - 1][1])
            i, j = (np.arange(z * FAN_OUT, min(below, (z + 1) * FAN_OUT)) for z in (x, y))
            if level == 1 and len({forest.find(int(k)) for k in (*i, *j)}) == 1:
                continue
            ok = self._may_link(level - 1, i, self, level - 1, j)
            for a, b in zip(*np.nonzero(ok), strict=True):
                if i[a] <= j[b]:
                    todo.append((level - 1, int(i[a]), int(j[b])))


def join_block(cids: list[int], sets: list[np.ndarray]) -> list[int]:
    """For each class of a block the smallest class that links lead to."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), cids[i]))
    forest = Forest(len(order))
    SignatureTree([sets[i] for i in order]).join(forest)
    least: dict[int, int] = {}
    for k, i in enumerate(order):
        r = forest.find(k)
        least[r] = min(least.get(r, cids[i]), cids[i])
    out = [0] * len(sets)
    for k, i in enumerate(order):
        out[i] = least[forest.find(k)]
    return out


def _tree_batches(leaves: int):
    """Rows (block, family, team, cid, hashes) in that order: a tree for each block, or for families of it that have `leaves` classes or more.

    A family of more is cut between teams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        block, family, team, cids, sets = None, None, None, [], []
        kin = 0  # classes of the family at hand
        out: list[list[int]] = [[], [], [], []]

        def done() -> None:
            for col, more in zip(out, ([block] * len(cids), cids, join_block(cids, sets), [task + number] * len(cids)), strict=True):
                col.extend(more)

        def batch_out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["block", "cid", "root", "tree"])

        for batch in batches:
            for b, f, t, c, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                kin = kin if f == family else 0
                if cids and (b != block or (len(cids) >= leaves and (f != family or (t != team and kin >= leaves)))):
                    done()
                    number, cids, sets, kin = number + 1, [], [], 0
                    if len(out[0]) >= 10_000:
                        yield batch_out()
                        out = [[], [], [], []]
                block, family, team = b, f, t
                kin += 1
                if not cids or c != cids[-1]:
                    cids.append(c)
                    sets.append(np.frombuffer(raw.as_buffer(), dtype=np.uint64))
        if cids:
            done()
        if out[0]:
            yield batch_out()

    return run


def _set_batches(shared, salt: int):
    """(doc_id, cid, hashes) of the documents that the id filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            some = batch.filter(_through(shared, batch.column("slot").to_numpy()))
            sets = shingle_sets(some.column("text"))
            cid = [_digest(s, salt)[0] if len(s) else None for s in sets]
            raw = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(cid, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "cid", "hashes"])

    return run


def _id_filter(ids: DataFrame, column: str = "doc_id") -> np.ndarray:
    """A bitmap of BITS places of the hashed ids: at most BITS / 64 rows come to the driver."""
    slot = F.pmod(F.xxhash64(column), F.lit(BITS))
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    out = np.zeros(BITS // 64, dtype=np.int64)
    for row in words.collect():
        out[row["w"]] = row["bits"]
    return out.view(np.uint64)


def _through(shared, slot: np.ndarray) -> pa.Array:
    """Whether a filter lets a slot through."""
    return pa.array((shared.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & U(1) == U(1))


def _only(shared):
    """Rows (cid, hashes) that the filter lets through: most others stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_through(shared, batch.column("slot").to_numpy())).select(["cid", "hashes"])

    return run


def _where_to(rows: pa.Table) -> pa.Table:
    """Trees that hold enough hashes of one class's prefix: a row for each hash, with the trees that have it."""
    cid, n, own = (rows.column(c)[0].as_py() for c in ("cid", "n", "own"))
    trees, shares = np.unique(rows.column("trees").combine_chunks().flatten().to_numpy(), return_counts=True)
    to = trees[(shares >= max(1, (PERCENT * n + 99) // 100 // SHARE)) & (trees != own)]
    return pa.table([pa.array([cid] * len(to), pa.int64()), pa.array(to, pa.int64())], names=["cid", "to"])


def _visit(key: tuple, residents: pa.Table, visitors: pa.Table) -> pa.Table:
    """Edges between parts of a tree's residents and of visiting classes that link."""
    edges: list[tuple[int, int]] = []
    if residents.num_rows and visitors.num_rows:
        sides = []
        for t in (residents, visitors):
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column(3)]
            order = sorted(range(len(sets)), key=lambda i, sets=sets: len(sets[i]))
            roots = t.column(2).to_pylist()
            sides.append(([sets[i] for i in order], [roots[i] for i in order]))
        (sets, roots), (sets_b, roots_b) = sides
        number = {r: k for k, r in enumerate(dict.fromkeys(roots + roots_b))}
        mine, theirs = [number[r] for r in roots], [number[r] for r in roots_b]
        forest = Forest(len(number))
        tree = SignatureTree(sets)
        for x, y in tree.links(SignatureTree(sets_b, tree.width), lambda x, y: forest.find(mine[x]) != forest.find(theirs[y])):
            forest.join(mine[x], theirs[y])
            edges.append((roots[x], roots_b[y]))
    cols = list(zip(*edges, strict=True)) or [[], []]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _met_elsewhere(shared: DataFrame, part: DataFrame, table) -> DataFrame:
    """Rows (hash, cid, n, tree) of classes that may link across trees: enough of their hashes are in two trees."""
    placed = table(shared.select("hash", "cid", "n").join(part.select("cid", "tree"), "cid"), "join-placed")
    two = placed.groupBy("hash").agg(F.min("tree").alias("a"), F.max("tree").alias("b")).where("a < b").select("hash")
    rows = placed.join(two, "hash", "left_semi").withColumn("shares", F.count("*").over(Window.partitionBy("cid")))
    return table(rows.where(F.col("shares") >= least_shared(F.col("n"))).drop("shares"), "join-met")


def _visits(rows: DataFrame, part: DataFrame, table) -> DataFrame:
    """(cid, to): the trees that each class may have links in.

    Classes of a block's largest part stay where they are; each other class asks, by the
    hashes of its prefix, which trees have enough of them.
    """
    size = part.groupBy("block", "root").agg(F.count("*").alias("size"))
    main = size.groupBy("block").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    restless = part.join(main, "block").where("root <> main").select("cid")
    asked = table(rows.join(restless, "cid", "left_semi").withColumnRenamed("tree", "own"), "join-asked")
    homes = rows.select("hash", "tree").distinct().groupBy("hash").agg(F.collect_list("tree").alias("trees"))  # a number for each tree
    hot = asked.groupBy("hash").count().where(F.col("count") * HOT > asked.count())
    hot = F.broadcast(hot.select("hash", F.lit(SALTS).alias("salts")))  # fewer than HOT rows
    salts = F.coalesce("salts", F.lit(1))
    asked = asked.join(hot, "hash", "left").select("hash", "cid", "n", "own", F.pmod(F.xxhash64("cid"), salts).alias("salt"))
    homes = homes.join(hot, "hash", "left").select("hash", "trees", F.explode(F.sequence(F.lit(0).cast("bigint"), salts.cast("bigint") - 1)).alias("salt"))
    met = asked.join(homes, ["hash", "salt"]).select("cid", "n", "own", "trees")
    return table(met.groupBy("cid").applyInArrow(_where_to, "cid bigint, to bigint"), "join-visits")


def _links_of(visits: DataFrame, rows: DataFrame, part: DataFrame, sets: DataFrame, leaves: int) -> DataFrame:
    """Edges (a, b) between parts that links of visiting classes with a tree's residents join."""
    some = rows.select("cid").distinct()
    bits = sets.sparkSession.sparkContext.broadcast(_id_filter(some, "cid"))  # BITS / 8 bytes
    near = sets.withColumn("slot", F.pmod(F.xxhash64("cid"), F.lit(BITS))).mapInArrow(_only(bits), "cid bigint, hashes binary")
    waves = visits.groupBy("to").agg(F.ceil(F.count("*") / leaves).alias("waves"))
    come = visits.join(waves, "to").select("cid", "to", F.pmod(F.xxhash64("cid"), F.col("waves")).alias("wave"))
    come = come.join(part.select("cid", "root"), "cid").join(near, "cid").select("to", "wave", "root", "hashes").toDF("at", "at_wave", "at_root", "at_hashes")
    stay = part.join(some, "cid", "left_semi").select("cid", "root", F.col("tree").alias("to")).join(waves, "to").join(near, "cid")
    stay = stay.select("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("waves") - 1)).alias("wave"), "root", "hashes")
    return stay.groupBy("to", "wave").cogroup(come.groupBy("at", "at_wave")).applyInArrow(_visit, "a bigint, b bigint")


def _merge_split_blocks(found: DataFrame, shared: DataFrame, sets: DataFrame, leaves: int, table) -> DataFrame:
    """(cid, root) of all classes, where blocks of several trees are joined across their trees.

    found: (block, cid, root, tree); a class that leads several teams is in several trees,
    which are joined by that. Then each class outside its block's largest part visits the
    trees that share enough with it.
    """
    split = found.groupBy("block").agg(F.min("tree").alias("a"), F.max("tree").alias("b")).where("a < b").select("block")
    whole = found.join(split, "block", "left_anti").select("cid", "root").distinct()  # leaders sit in one tree more than once
    twice = table(found.join(split, "block", "left_semi"), "join-split")
    if twice.isEmpty():
        return whole
    leads = twice.groupBy("cid").agg(F.min("root").alias("b"), F.max("root").alias("most")).where("b < most")
    edges = twice.join(leads, "cid").where("root <> b").select(F.col("root").alias("a"), "b")
    part = _joined(twice.groupBy("block", "cid").agg(F.min("root").alias("root"), F.min("tree").alias("tree")), edges, table)
    rows = _met_elsewhere(shared, part, table)
    part = _joined(part, _links_of(_visits(rows, part, table), rows, part, sets, leaves), table)
    return whole.unionByName(part.select("cid", "root"))


def _joined(part: DataFrame, edges: DataFrame, table) -> DataFrame:
    """part, its roots joined along the edges (a, b)."""
    up = components(edges, table, "join-parts").select("node", F.col("root").alias("above"))
    return table(part.join(up, part["root"] == up["node"], "left").select("block", "cid", F.coalesce("above", "root").alias("root"), "tree"), "join-split")


def _one_set_each(full: DataFrame) -> bool:
    """Whether each class has one set: 128 bits of its digest agree where 64 do."""
    return full.where("cid IS NOT NULL").groupBy("cid").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).where("a < b").isEmpty()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaves: int = LEAVES) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

    Exact in five steps. (1) Documents of equal sets form a class. (2) Each class lists the
    prefix of its set under one order of all hashes, places frequent over all documents
    last. Prefixes are so long that linked classes share many hashes; classes that share
    too few with all others together are peeled off. (3) Classes that the shared hashes
    left connect form a block. In it, classes follow the one that leads most of their
    hashes; those that so hang together are a family. (4) Each block is joined by a
    signature tree; blocks of more than `leaves` classes are split between families over
    trees and tasks, and large families too, a leader being in each tree of its followers.
    (5) Trees of one block are joined by their common leaders; then each class outside the
    block's largest part visits the trees that share enough of its prefix. Only links
    decide on components; copies are never paired, and pairs already in one part aren't
    compared.

    Returns one row for each input row: doc_id, n_shingles, component_id (the smallest id
    that links lead to, itself included). Null text, empty texts and texts without words
    have no shingles and link with nothing. Rows that repeat an id are one document; a row
    with a null id links with nothing and its component is null. No rows give no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with work_tables(spark) as table, batch_rows(spark, ROWS_A_BATCH):
        with batch_rows(spark, TEXTS):
            level = spark.sparkContext.broadcast(frequency_levels(own))  # SLOTS bytes
            salt, full = 0, None
            while full is None or not _one_set_each(full):  # classes that hold different sets: other digests
                if full is not None:
                    drop_table(full)
                    salt += 1
                full = table(own.mapInArrow(_class_batches(level, salt), "doc_id bigint, n int, cid bigint, twin bigint, prefix array<bigint>"), "join-classes")
        index = full.where("prefix IS NOT NULL").select(F.explode("prefix").alias("hash"), "cid", "n", F.lit(0).alias("weight"))
        index = table(enough_shared(shared_by_range(index, n)), "join-index")
        rows = table(full.select("doc_id", "n", "cid"), "join-rows", keep=True)
        drop_table(full)
        labels = table(_labels(own, rows, index, n, leaves, salt, table), "join-components", keep=True)
    out = rows.select("doc_id", "n", "cid").join(labels, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"))


def _labels(own: DataFrame, rows: DataFrame, index: DataFrame, n: int, leaves: int, salt: int, table) -> DataFrame:
    """(cid, component_id) of each class."""
    spark = own.sparkSession
    shared = table(shared_by_range(index, n), "join-shared")
    drop_table(index)
    stars = table(shared.groupBy("cid", "head").agg(F.count("*").alias("shares")), "join-stars")
    edges = stars.where("cid <> head").select(F.col("cid").alias("a"), F.col("head").alias("b"))
    cut = shared.where("cut").select("hash", "head").distinct()  # two hashes a range
    least = cut.groupBy("hash").agg(F.min("head").alias("b"))
    edges = edges.unionByName(cut.join(least, "hash").where("head <> b").select(F.col("head").alias("a"), "b"))
    blocks = components(edges, table, "join-blocks")
    blocks = blocks.unionByName(blocks.select(F.col("root").alias("node"), "root").distinct()).toDF("cid", "block")
    team = table(stars.groupBy("cid").agg(F.max_by("head", F.struct("shares", "head")).alias("team")), "join-teams")
    family = components(team.select(F.col("cid").alias("a"), F.col("team").alias("b")), table, "join-families").select(F.col("node").alias("cid"), F.col("root").alias("family"))
    classes = rows.where("doc_id IS NOT NULL AND cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    classes = table(classes, "join-firsts")
    keys = blocks.join(team, "cid").join(family, "cid", "left").withColumn("family", F.coalesce("family", "cid"))
    keys = table(keys.join(classes, "cid"), "join-keys")
    seats = table(_seats(keys, leaves), "join-seats")
    wanted = spark.sparkContext.broadcast(_id_filter(keys))  # BITS / 8 bytes
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("slot")
    sets = own.where("doc_id IS NOT NULL").select("doc_id", slot, "text").mapInArrow(_set_batches(wanted, salt), "doc_id bigint, cid bigint, hashes binary")
    sets = sets.join(seats, ["doc_id", "cid"]).dropDuplicates(["doc_id", "cid", "block", "family", "team", "part"])
    with batch_rows(spark, TEXTS):
        sets = table(sets.select("block", "family", "team", "part", "guest", "cid", "hashes"), "join-sets")
    dealt = sets.repartitionByRange(n, "block", "family", "team", "part").sortWithinPartitions("block", "family", "team", "part", "cid")
    dealt = dealt.select("block", "family", F.xxhash64("team", "part").alias("team"), "cid", "hashes")
    found = table(dealt.mapInArrow(_tree_batches(leaves), "block bigint, cid bigint, root bigint, tree bigint"), "join-trees")
    part = _merge_split_blocks(found, shared, sets.where("NOT guest").select("cid", "hashes"), leaves, table).join(keys.select("cid", "doc_id"), "cid")
    least = part.groupBy("root").agg(F.min("doc_id").alias("least"))
    least = part.join(least, "root").select("cid", "least")
    return classes.join(least, "cid", "left").select("cid", F.coalesce("least", "doc_id").alias("component_id"))


def _seats(keys: DataFrame, leaves: int) -> DataFrame:
    """Where the classes of keys(cid, block, family, team, doc_id) are to meet: (doc_id, cid, block, family, team, part, guest).

    A team is the classes with one leader; a large one is dealt over parts of about
    `leaves` classes. The leader is in each part, as a guest where its own place is
    another, so that its links join the parts.
    """
    size = keys.groupBy("team").agg(F.ceil(F.count("*") / leaves).alias("parts"))
    own = keys.join(size, "team")
    own = own.select("doc_id", "cid", "block", "family", "team", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"))
    lead = size.join(keys.select("doc_id", "cid", "block", "family"), size["team"] == keys["cid"])
    lead = lead.select("doc_id", "cid", "block", "family", F.col("cid").alias("team"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    guests = lead.join(own.select("cid", "team", "part"), ["cid", "team", "part"], "left_anti").select(*own.columns)
    return own.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that another document of their component stands for (the smallest id).

    Rows that repeat a kept id all stay, as do rows with a null id; null, empty and blank
    texts stay; no rows give no rows. Columns may have any names.
    """
    gone = similar(docs, id_col, text_col).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, docs[id_col] == gone["doc_id"], "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w
), u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS inter
      FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * inter >= 75 * (na + nb - inter)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""

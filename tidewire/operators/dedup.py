"""Exact and near duplicates of captured items, and source resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import bits

from .graph import cut

#: By width, up to so many different fingerprints: blocks, and blocks that must agree. Keys grow from 16 to 25 and 32 of 64 bits,
#: from 12 to 20 of 32. Texts set some bits far more often than others, so keys are longer than even bits would need.
SCHEMES = {64: ((400_000, 4, 1), (8_000_000, 5, 2), (float("inf"), 6, 3)), 32: ((30_000, 5, 2), (200_000, 6, 3), (1_000_000, 7, 4), (float("inf"), 8, 5))}
#: Fingerprints of one block of a large key, every how many-th is looked at to find large keys, and pairs that leave a task at a time.
ROWS, SAMPLE, PAIRS = 4096, 16, 1 << 18
#: Items of one era, in which a key's rows are in one task; steps back that all rows of a task take together; rows a single one looks at first then.
ERA, STEPS, LOOK = 1 << 20, 256, 1 << 10


def _scheme(n: int, width: int) -> tuple[int, int]:
    return next((blocks, same) for most, blocks, same in SCHEMES[64 if width > 32 else 32] if n <= most)


def near_pairs(hashes: DataFrame, hash_col: str = "simhash", width: int = 64, within: int = bits.NEAR, scheme: tuple[int, int] | None = None) -> DataFrame:
    """Pairs (a, b) of different fingerprints, both ways, that differ in `within` bits at most.

    Fingerprints are made distinct first, so copies cost nothing; a pair within 3 bits
    agrees in all bits of some choice of blocks, so meeting on (band, value) loses
    none. The number of fingerprints chooses how long the keys are, so that chance
    meetings stay few; those that remain are compared as arrays where a key's rows are sorted together, and only close
    pairs leave the task. A pair counts in the first band in which it agrees, once, and is turned both ways then, so
    pairs are not shuffled. 0, the fingerprint of no tokens, takes no part.
    """
    # Counted, then met with itself. The filter comes after the cut: before, Spark would work out each fingerprint twice, for it and for the row.
    one = cut(hashes.select(F.col(hash_col).alias("h")).distinct()).where("h <> 0")
    n = one.count()
    blocks, same = scheme or _scheme(n, width)
    banded = one.select("h", F.inline(bits.block_keys(F.col("h"), width, blocks, same)))
    keyed = banded.select(F.shiftleft("value", 8).bitwiseOR(F.col("band")).alias("key"), "h")  # one number, which sorts by radix
    met = _tiled(keyed, n).repartition("key").sortWithinPartitions("key").mapInArrow(_close(within), "band int, a bigint, b bigint")
    close = met.where(F.col("band") == bits.first_band(F.col("a").bitwiseXOR(F.col("b")), width, blocks, same))
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    return close.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def _tiled(keyed: DataFrame, n: int) -> DataFrame:
    """keyed(key, h) with side: rows of one key meet, of sides 1 and 2 those of the other side only.

    A key with more than ROWS rows, and more than 1/1024 of all, is dealt over blocks of about ROWS (512 blocks at most), each two of
    which meet under a key of their own, with the tile's number above its 44 bits. Such keys are looked for in every SAMPLE-th
    fingerprint: a key that is missed is compared in one task, whole.
    """
    most = max(ROWS, n >> 10)
    if n <= most:
        return keyed.select("key", "h", F.lit(0).alias("side"))
    some = keyed.where(F.pmod(F.xxhash64("h"), F.lit(SAMPLE)) == 0).groupBy("key").agg((F.count("*") * SAMPLE).alias("rows"))
    # 1024 keys of each band at most.
    large = cut(some.where(F.col("rows") > most).select("key", F.least(F.ceil(F.col("rows") / ROWS), F.lit(512)).alias("blocks")))
    own = F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks"))
    lo, hi = F.least(own, F.col("o")), F.greatest(own, F.col("o"))
    tile = F.coalesce(F.shiftleft(lo * F.col("blocks") + hi, 44), F.lit(0))
    side = F.when(lo == hi, 0).when(own == lo, 1).when(own == hi, 2).otherwise(0)
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - 1)).alias("o")
    dealt = keyed.join(F.broadcast(large), "key", "left").select("key", "h", "blocks", others)
    return dealt.select(F.col("key").bitwiseOR(tile).alias("key"), "h", side.alias("side"))


def _close(within: int):
    """(band, a, b), a < b: the fingerprints of one key, of rows (key, h, side) sorted by it, that differ in `within` bits at most."""

    def found(key: np.ndarray, h: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        end, at, step, held, n = np.repeat(starts + sizes, sizes), np.arange(len(key)), 0, [], 0
        while True:  # each row with the one `step` rows below
            step += 1
            at = at[at + step < end[at]]
            if len(at):
                near = np.bitwise_count((h[at] ^ h[at + step]).view(np.uint64)) <= within  # of signed numbers it counts the absolute value
                near &= (side[at] == 0) | (side[at] != side[at + step])
                held.append((at[near], at[near] + step))
                n += len(held[-1][0])
            if n >= PAIRS or n and not len(at):
                x, y = (np.concatenate(p) for p in zip(*held, strict=True))
                columns = (key[x] & 255).astype(np.int32), np.minimum(h[x], h[y]), np.maximum(h[x], h[y])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["band", "a", "b"])
                held, n = [], 0
            if not len(at):
                return

    return _by_key(found, "key", "h", "side")


def _by_key(found, *columns: str):
    """found(*arrays) over batches whose rows are sorted by the first of columns; all rows of a key are in one call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in columns]
            rows = rows if rest is None else [np.concatenate(c) for c in zip(rest, rows, strict=True)]
            if not len(rows[0]):
                continue
            whole = np.searchsorted(rows[0], rows[0][-1])  # the last key may go on in the next batch
            rest = [c[whole:] for c in rows]
            if whole:
                yield from found(*(c[:whole] for c in rows))
        if rest is not None and len(rest[0]):
            yield from found(*rest)

    return run


def first_with(items: DataFrame, key: str, id_col: str = "id", out: str = "first") -> DataFrame:
    """items with the smallest id that has the same key.

    An aggregation, which combines map-side, and a join, whose skew AQE splits: a key that
    very many rows share is in no one task, as it would be in a window.
    """
    least = items.groupBy(key).agg(F.min(id_col).alias(out))
    return items.join(least, key, "left")


def classify(items: DataFrame, width: int = 64) -> DataFrame:
    """The cascade url -> content -> fingerprint over items(id, url_hash, content_hash, simhash).

    An item is a duplicate of the earliest one with its URL or, failing that, its content
    (exact), or of the newest earlier one with a near fingerprint. Later checks see only
    what earlier ones left. Returns id, dedup_status, duplicate_of; a repeated URL is
    recorded like any other sighting.

    The newest earlier item is looked up among the ids of a near or equal fingerprint by slots,
    never by all pairs of a frequent fingerprint's items. Of 32 bits very many are near by chance, so there each key's
    rows are looked through from the asker back, until one is near (near_before).
    """
    items = cut(items.select("id", "url_hash", "content_hash", "simhash"))  # read three times
    first = first_with(first_with(items, "url_hash", out="u"), "content_hash", out="c")
    owner = F.when(F.col("u") < F.col("id"), F.col("u")).when(F.col("c") < F.col("id"), F.col("c"))
    exact = cut(first.select("id", "simhash", owner.alias("owner")))  # read by the search and by the result
    asking, seen = exact.where("owner IS NULL AND simhash <> 0").select("id", "simhash"), exact.select("id", "simhash")
    near = near_before(asking, seen, width) if width <= 32 else newest_before(asking, seen, near_pairs(exact, "simhash", width))
    out = exact.join(near, "id", "left")
    status = F.when(F.col("owner").isNotNull(), "exact_duplicate").when(F.col("near").isNotNull(), "near_duplicate").otherwise("unique")
    return out.select("id", status.alias("dedup_status"), F.coalesce("owner", "near").alias("duplicate_of"))


#: Ids of one fingerprint that are looked through one by one.
STEP = 1024


def near_before(asking: DataFrame, items: DataFrame, width: int = 32, within: int = bits.NEAR, era: int | None = None) -> DataFrame:
    """(id, near): for each asking(id, simhash) the largest smaller id of items(id, simhash) with an equal or near fingerprint of 32 bits at most.

    Rows that agree in a choice of blocks meet in one task, in the order of ids; an asker steps back until one is near, so a pair
    that is not the answer is hardly ever made, and the largest of what its keys give is the newest. Ids are cut into eras of about `era`
    items by value, which bounds the rows of one key. Askers that find nothing in their own era meet, of all eras, each fingerprint's largest id.
    """
    kind = items.schema["id"].dataType
    row = lambda df, n: df.where("simhash <> 0 AND id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("simhash").cast("bigint").alias("h"), F.lit(n).alias("kind"))
    rows = cut(row(items, 1).unionByName(row(asking, 2)).groupBy("id", "h").agg(F.bit_or("kind").alias("kind")))
    low, high, n = rows.agg(F.min("id"), F.max("id"), F.count("*")).first()
    span = max(1, -(-(high - low + 1) * (era or ERA) // n)) if n else 1
    rows = rows.withColumn("era", F.floor((F.col("id") - F.lit(low)) / F.lit(span)).cast("bigint"))
    found = _newest(rows, _scheme(min(n, era or ERA), width), width, within)
    if n and high - low >= span:
        found = cut(found)
        tops = rows.where("kind <> 2").groupBy("h", "era").agg(F.max("id").alias("id"), F.lit(1).alias("kind"))
        left = rows.where("kind >= 2").join(found, "id", "left_anti").withColumn("kind", F.lit(2))
        both = tops.unionByName(left).withColumn("era", F.lit(0).cast("bigint"))
        found = found.unionByName(_newest(both, _scheme(n, width), width, within))
    return found.select(F.col("id").cast(kind), F.col("near").cast(kind))


def _newest(rows: DataFrame, scheme: tuple[int, int], width: int, within: int) -> DataFrame:
    """(id, near) of rows(id, h, kind, era), kind 1 for items, 2 for askers, 3 for both: the largest smaller id of an equal or near item of one era, where there is one."""
    before = Window.partitionBy("era", "h").orderBy("id").rangeBetween(Window.unboundedPreceding, -1)  # an id may come twice, as item and as asker
    equal = rows.select("id", "kind", F.max(F.when(F.col("kind") != 2, F.col("id"))).over(before).alias("near")).where("kind >= 2 AND near IS NOT NULL")
    met = _met_in(rows, scheme, width, within)
    return equal.select("id", "near").unionByName(met.select("id", "near")).groupBy("id").agg(F.max("near").alias("near"))


def _met_in(rows: DataFrame, scheme: tuple[int, int], width: int, within: int) -> DataFrame:
    """(id, near, a, b), for each key of an asker: the newest item before it with a fingerprint b that differs from its own, a, in 1 to `within` bits, if none is equal from there on."""
    keyed = rows.select("id", "h", "kind", "era", F.inline(bits.block_keys(F.col("h"), width, *scheme)))
    key = F.shiftleft("era", 32).bitwiseOR(F.shiftleft(F.col("band").cast("bigint"), 24)).bitwiseOR(F.col("value"))  # one number, which sorts by radix
    met = keyed.select(key.alias("key"), "h", "id", F.col("kind").cast("byte").alias("kind")).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(_by_key(_back(within), "key", "h", "id", "kind"), "id bigint, near bigint, a bigint, b bigint")


def _back(within: int):
    """Rows (id, near, a, b) of _met_in for whole keys: each asker steps back in the order of ids until an item is equal or near."""

    def found(key: np.ndarray, h: np.ndarray, ids: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, key))
        key, h, ids, item, at = key[order], h[order].astype(np.uint32), ids[order], kind[order] != 2, np.flatnonzero(kind[order] >= 2)
        new = np.r_[True, key[1:] != key[:-1]]
        first, held = np.flatnonzero(new)[np.cumsum(new) - 1], []
        for step in range(1, STEPS + 1):  # each asker with the row `step` rows before
            at = at[at - step >= first[at]]
            if not len(at):
                break
            near = (np.bitwise_count(h[at] ^ h[at - step]) <= within) & item[at - step] & (ids[at - step] < ids[at])
            held.append((at[near], at[near] - step))
            at = at[~near]
        for i in at.tolist():  # the few that go on, each for itself
            end, look = i - STEPS, LOOK
            while end > first[i]:
                begin = max(int(first[i]), end - look)
                near = np.flatnonzero((np.bitwise_count(h[begin:end] ^ h[i]) <= within) & item[begin:end] & (ids[begin:end] < ids[i]))
                if len(near):
                    held.append((np.array([i]), near[-1:] + begin))
                    break
                end, look = begin, 4 * look
        if held:
            x, y = (np.concatenate(p) for p in zip(*held, strict=True))
            x, y = x[h[x] != h[y]], y[h[x] != h[y]]
            columns = ids[x], ids[y], h[x].astype(np.int64), h[y].astype(np.int64)
            for a in range(0, len(x), PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + PAIRS]) for c in columns], names=["id", "near", "a", "b"])

    return found


def newest_before(asking: DataFrame, items: DataFrame, pairs: DataFrame, *by: str) -> DataFrame:
    """(id, near): for each asking(id, simhash) the largest smaller id of items whose fingerprint is its own or, by pairs(a, b), near.

    Pairs that hold for some askers only have columns `by` in common with those.

    Each fingerprint's ids are cut into slots of STEP by value; an asker reads its own slot's
    ids below it, and of all slots below only their largest id, so the work of a frequent
    fingerprint grows with its items and slots, not with their square.
    """
    slot = F.floor(F.col("id") / STEP)
    seen = items.where("simhash <> 0").select(F.col("simhash").alias("b"), F.col("id").alias("other"), slot.alias("slot"))
    tops = seen.groupBy("b", "slot").agg(F.max("other").alias("top"))
    before = Window.partitionBy("b").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    asks = asking.select("id", F.col("simhash").alias("a"), slot.alias("slot"), *by)
    asks = asks.join(pairs, [*by, "a"]).select("id", "b", "slot").unionByName(asks.select("id", F.col("a").alias("b"), "slot"))
    inside = asks.join(seen, ["b", "slot"]).where("other < id").groupBy("id").agg(F.max("other").alias("near"))
    # Of the slots below, the asker's fingerprint has one that is next: the largest top there.
    marks = tops.select("b", "slot", "top").unionByName(asks.select("b", "slot").distinct().withColumn("top", F.lit(None).cast("bigint")))
    lower = marks.groupBy("b", "slot").agg(F.max("top").alias("top")).withColumn("below", F.max("top").over(before)).select("b", "slot", "below")
    under = asks.join(lower, ["b", "slot"]).where("below IS NOT NULL").groupBy("id").agg(F.max("below").alias("near"))
    return inside.unionByName(under).groupBy("id").agg(F.max("near").alias("near"))


def classify_new(new: DataFrame, stored: DataFrame, width: int = 64) -> DataFrame:
    """classify() of new items behind stored ones: only stored items that share a hash or a block of bits with a new one are looked at."""
    columns = ["id", "url_hash", "content_hash", "simhash"]
    new, old = cut(new.select(*columns)), stored.select(*columns)
    keys = lambda df: df.select("id", F.inline(bits.block_keys(F.col("simhash"), width, 4, 1)))
    bands = keys(old.where("simhash <> 0")).join(keys(new.where("simhash <> 0")).select("band", "value").distinct(), ["band", "value"], "left_semi").select("id")
    same = [old.join(new.select(h).distinct(), h, "left_semi").select("id") for h in ("url_hash", "content_hash")]
    near = bands.unionByName(same[0]).unionByName(same[1]).distinct()
    found = classify(old.join(near, "id", "left_semi").unionByName(new), width)
    return found.join(new.select("id"), "id", "left_semi")


def new_sources(hosts: DataFrame, known: DataFrame, key: str = "domain") -> DataFrame:
    """Hosts that the dimension doesn't have yet."""
    return hosts.select(key).where(F.col(key).isNotNull() & (F.col(key) != "")).distinct().join(known.select(key), key, "left_anti")


def unseen(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Insert-or-ignore: the rows whose key isn't stored, one for each key."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")

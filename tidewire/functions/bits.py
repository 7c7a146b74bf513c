"""SimHash fingerprints and their bands."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tokens

# Bits that may differ, characters of the body that count, bands.
NEAR, BODY_CHARS, BANDS = 3, 400, 4


#: Words whose bits are laid out at a time: 64 bytes a word. Bytes of texts that are split into words at a time.
AT_ONCE, SPLIT = 1 << 16, 4 << 20


def _blake2b(word: str) -> bytes:
    return hashlib.blake2b(word.encode(), digest_size=8).digest()


def _md5(word: str) -> bytes:
    return hashlib.md5(word.encode()).digest()[:8]


def _voted(digests: list[bytes], found: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """For each of `sizes` words in a row: bit b is set if more of them have it set in their digest's first `bits` bits than not.

    `found` has the words of all texts, one after another, as places in digests. 64 bits are signed, 32 are not negative.
    """
    set_ = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)[:, : bits // 8], axis=1)
    ones, ends = np.zeros((len(sizes), bits), np.int64), np.cumsum(sizes)
    some = np.flatnonzero(sizes)  # reduceat has no empty sums
    starts = ends[some] - sizes[some]
    a = 0
    while a < len(some):
        b = max(a + 1, int(np.searchsorted(ends[some], starts[a] + AT_ONCE, "right")))
        ones[some[a:b]] = np.add.reduceat(set_[found[starts[a] : ends[some[b - 1]]]], starts[a:b] - starts[a], axis=0, dtype=np.int64)
        a = b
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">i8" if bits == 64 else ">u4")[:, 0].astype(np.int64)


def fingerprint(found: list[str]) -> int:
    """Bit b is set if more word occurrences have it set in their 64-bit blake2b than not; signed."""
    return int(_voted([_blake2b(w) for w in found], np.arange(len(found)), np.array([len(found)]), 64)[0])


def _fingerprints(digest: Callable[[str], bytes], bits: int) -> Callable[[Column], Column]:
    """Fingerprints of lower-cased texts: a batch's words are told apart and hashed once each, and all its texts vote together."""

    def some(texts: pa.Array) -> np.ndarray:
        split = pc.split_pattern_regex(texts, "[^a-z0-9']+")  # what is left are the tokens, and empty strings at the ends
        of, words = pc.list_parent_indices(split).to_numpy(), split.flatten().dictionary_encode()
        known, found = words.dictionary.to_pylist(), words.indices.to_numpy()
        if "" in known:
            word = found != known.index("")
            of, found = of[word], found[word]
        return _voted([digest(w) for w in known], found, np.bincount(of, minlength=len(texts)), bits)

    @F.arrow_udf(T.LongType())
    def prints(texts: pa.Array) -> pa.Array:
        ends, out, a = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), [], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SPLIT, "right")))
            out.append(some(texts[a:b]))
            a = b
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))

    return prints


def _counted(title: Column, body: Column, whole: bool = False) -> Column:
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), body if whole else F.left(body, F.lit(BODY_CHARS)))


def words(title: Column, body: Column) -> Column:
    return tokens(_counted(title, body))


def simhash(title: Column, body: Column) -> Column:
    """The exact 64-bit fingerprint (blake2b, in an Arrow UDF)."""
    return _fingerprints(_blake2b, 64)(F.lower(_counted(title, body)))


def simhash_md5(title: Column, body: Column, bits: int = 32, whole: bool = False) -> Column:
    """A fingerprint of `bits` bits (32 or 64) from md5 (in an Arrow UDF), which SQL engines reproduce; 64 bits are signed. whole: all of the body counts."""
    return _fingerprints(_md5, bits)(F.lower(_counted(title, body, whole)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(h: Column, bits: int = 64) -> Column:
    """(band, value) structs; fingerprints within NEAR bits agree in one band at least."""
    return block_keys(h, bits, BANDS, 1)


def block_keys(h: Column, bits: int, blocks: int, same: int) -> Column:
    """(band, value) structs, one for each choice of `same` out of `blocks` blocks of bits.

    Fingerprints that differ in blocks - same bits at most agree in all bits of one choice.
    More blocks make longer keys, so fewer fingerprints meet by chance.
    """
    edges = [bits * i // blocks for i in range(blocks + 1)]
    out = []
    for band, chosen in enumerate(combinations(range(blocks), same)):
        value, at = F.lit(0).cast("bigint"), 0
        for i in chosen:
            part = F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1).cast("bigint"))
            value, at = value.bitwiseOR(F.shiftleft(part, at)), at + edges[i + 1] - edges[i]
        out.append(F.struct(F.lit(band).alias("band"), value.alias("value")))
    return F.array(*out)


def first_band(differ: Column, bits: int, blocks: int, same: int) -> Column:
    """The first band of block_keys in which two fingerprints agree whose exclusive or is `differ`; null where they agree in none."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    agree = F.lit(0)
    for i in range(blocks):
        mask = (1 << edges[i + 1]) - (1 << edges[i])
        signed = F.lit(mask - 2**64 if mask >> 63 else mask).cast("bigint")
        agree = agree + F.when(differ.bitwiseAND(signed) == 0, 1 << i).otherwise(0)
    chosen = [sum(1 << i for i in c) for c in combinations(range(blocks), same)]
    # By the set of blocks that agree, so that many bands cost no more than few.
    first = [next((band for band, c in enumerate(chosen) if c & found == c), -1) for found in range(1 << blocks)]
    return F.nullif(F.get(F.lit(first), agree), F.lit(-1))

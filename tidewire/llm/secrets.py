"""Secret scans: base patterns, and tokens that a battery of randomness tests finds."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import TEXTS, batch_rows, slices, work_table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Runs of {n,} are the runs of + that are long enough.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, narrowest first: name, alphabet, classes of which each must occur.
ENCODINGS = (
    ("hex", DIGITS + "abcdef", (DIGITS, "abcdef")),
    ("hex", DIGITS + "ABCDEF", (DIGITS, "ABCDEF")),
    ("base32", UPPER + "234567", (UPPER, "234567")),
    ("base36", DIGITS + LOWER, (DIGITS, LOWER)),
    ("base36", DIGITS + UPPER, (DIGITS, UPPER)),
    ("base62", DIGITS + LOWER + UPPER, (DIGITS, LOWER, UPPER)),
    ("base64", UPPER + LOWER + DIGITS + "+/", (DIGITS, LOWER, UPPER)),
    ("base64url", UPPER + LOWER + DIGITS + "-_", (DIGITS, LOWER, UPPER)),
)
#: Percent of a, b, c ... z in plain English text (fixed values).
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Share of false finds allowed among all finds in a table.
FDR = 0.01
#: In ordinary text high and low characters alternate less and follow each other more than in random draws: by so many
#: standard deviations times the root of the length, runs and serial correlation; and how far both, and chi-squared, spread there.
STICKY, SERIAL, SPREAD = -0.15, 0.1, 1.5
#: Characters that a cell of chi-squared is to expect.
CELL = 5
#: Log evidence is counted in so many steps of STEP; what is above or below falls into the last or first.
STEPS, STEP = 4096, 1 / 16


def _ordinary() -> dict[str, float]:
    """Chance of a character in an ordinary identifier or word."""
    out = {}
    for c, p in zip(LOWER, LETTERS, strict=True):
        out[c], out[c.upper()] = 0.8 * p / sum(LETTERS), 0.1 * p / sum(LETTERS)
    return out | {c: 0.07 / 10 for c in DIGITS} | {c: 0.03 / 4 for c in "+/-_"}


ORDINARY = _ordinary()


@lru_cache
def _places(alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """By code, the place of a character in the alphabet, and its rank by how often ordinary text has it."""
    place, rank = np.full(128, -1), np.full(128, -1)
    place[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    rank[[ord(c) for c in sorted(alphabet, key=lambda c: (-ORDINARY[c], c))]] = np.arange(len(alphabet))
    return place, rank


@lru_cache
def _cells(alphabet: str, cells: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Cells of like frequent characters: by rank, and their chances under uniform draws; what ordinary text adds to chi-squared, at once and for each character."""
    cell = np.arange(len(alphabet)) * cells // len(alphabet)
    p = np.bincount(cell) / len(alphabet)
    q = np.bincount(cell, np.sort([ORDINARY[c] for c in alphabet])[::-1])
    q /= q.sum()
    return cell, p, float((q * (1 - q) / p).sum()), float(((q - p) ** 2 / p).sum())


def encoding(token: str) -> tuple[str, str] | None:
    seen = set(token)
    for name, alphabet, classes in ENCODINGS:
        if seen <= set(alphabet) and all(seen & set(c) for c in classes):
            return name, alphabet
    return None


def cells_of(n: int, alphabet: str) -> int:
    """Cells of chi-squared: so few that each expects CELL characters of a token, if it can."""
    return max(2, min(len(alphabet), n // CELL))


def battery(token: str, alphabet: str) -> tuple[float, float, float]:
    """Standard scores, under uniform draws from the alphabet, of chi-squared, runs about the middle and serial correlation."""
    code = np.frombuffer(token.encode(), np.uint8)
    place, rank = _places(alphabet)
    x, n = place[code].astype(float), len(code)
    cell, p, _, _ = _cells(alphabet, cells_of(n, alphabet))
    chi = float(((np.bincount(cell[rank[code]], minlength=len(p)) - n * p) ** 2 / (n * p)).sum())
    z_chi = (chi - (len(p) - 1)) / math.sqrt(2 * (len(p) - 1) * (n - 1) / n)
    high = x >= len(alphabet) / 2
    a, b = int(high.sum()), n - int(high.sum())
    z_runs = -math.sqrt(n)  # one side only: as few runs as can be
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        z_runs = (runs - mean) / math.sqrt(var) if var > 0 else z_runs
    d = x - x.mean()
    s = float((d * d).sum())
    z_serial = float((d[1:] * d[:-1]).sum()) / s * math.sqrt(n) if s else math.sqrt(n)
    return z_chi, z_runs, z_serial


def _ratio(z: float, mean: float, spread: float) -> float:
    """Log of the density of z under uniform draws (standard normal) over that in ordinary text."""
    return math.log(spread) - z * z / 2 + ((z - mean) / spread) ** 2 / 2


def evidence(token: str, alphabet: str) -> float:
    """Log likelihood ratio of the battery's three scores, uniform draws against ordinary text of the same length."""
    n = len(token)
    z_chi, z_runs, z_serial = battery(token, alphabet)
    _, p, within, apart = _cells(alphabet, cells_of(n, alphabet))
    df = len(p) - 1
    sd = math.sqrt(2 * df * (n - 1) / n)
    mean = (within + n * apart - df) / sd
    spread = max(SPREAD, math.sqrt(2 * (df + 2 * n * apart)) / sd)
    far = math.sqrt(n)
    return _ratio(z_chi, mean, spread) + _ratio(z_runs, STICKY * far, SPREAD) + _ratio(z_serial, SERIAL * far, SPREAD)


def tested(text: str) -> list[tuple[int, int, float]]:
    """Start, end and log evidence, weighed by length, of each token with an encoding; without the mean length that weights divide by."""
    out = []
    for m in TOKEN.finditer(text):
        if found := encoding(m[0]):
            out.append((m.start(), m.end(), evidence(m[0], found[1]) + math.log(m.end() - m.start())))
    return out


def least_step(counts: dict[int, int], n: int, chars: int) -> int:
    """The lowest step of evidence that stands, if n tokens of so many characters were tested and counts are by step.

    Short tokens are weak, so each weighs by its length, with a mean weight of 1. The k
    best stand if the k-th weighted likelihood ratio is at least n / (FDR * k), which
    holds the share of false finds whatever the dependence between tokens.
    """
    k, least = 0, STEPS + 1
    for step in sorted(counts, reverse=True):
        k += counts[step]
        if step * STEP - math.log(chars / n) >= math.log(n / (FDR * k)):
            least = step
    return least


def step_of(weighed: float) -> int:
    return max(0, min(STEPS, math.floor(weighed / STEP)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(base, key=lambda s: (s[1], KINDS.index(s[0])))


def merged(base: list[tuple[str, int, int]], more: list[tuple[int, int, float]]) -> list[tuple[str, int, int, int | None]]:
    """All spans by start, then kind; of `more`, in order of place, those that overlap no base span, with their step."""
    out, i, reach = [(*s, None) for s in base], 0, 0
    for a, b, e in more:
        while i < len(base) and base[i][1] < b:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= a:
            out.append(("random", a, b, step_of(e)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text that is a table of its own; code points, end exclusive."""
    more = tested(text)
    if not more:
        return base_spans(text)
    counts = Counter(step_of(e) for *_, e in more)
    least = least_step(counts, len(more), sum(b - a for a, b, _ in more))
    return [s[:3] for s in merged(base_spans(text), more) if s[3] is None or s[3] >= least]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("step", pa.int32())]))
SCAN_DDL = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,step:int>>, tested array<struct<step:int,n:bigint,chars:bigint>>"
TESTED = pa.list_(pa.struct([("step", pa.int32()), ("n", pa.int64()), ("chars", pa.int64())]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        spans, counts = [], []
        for t in batch.column(1).to_pylist():
            more = tested(t)
            by: dict[int, list[int]] = {}
            for a, b, e in more:
                one = by.setdefault(step_of(e), [0, 0])
                one[0], one[1] = one[0] + 1, one[1] + b - a
            counts.append([{"step": s, "n": n, "chars": c} for s, (n, c) in by.items()])
            more = [m for m in more if m[2] > 0]  # step 0 never stands
            spans.append([{"kind": k, "start": a, "end": b, "step": s} for k, a, b, s in merged(base_spans(t), more)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS), pa.array(counts, TESTED)], names=["doc_id", "spans", "tested"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text: doc_id, spans array of (kind, start, end).

    Besides the base patterns, tokens whose battery gives enough evidence that they are
    random. All tokens of the table are tested together: their evidence is counted by
    step, and false finds are held to a share FDR of all finds in the table.

    Null text is empty and has no spans; rows are taken one by one, so null ids, repeated
    rows and ties change nothing but the counts; very long texts are read whole, in time
    linear in their length; no rows give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with batch_rows(docs.sparkSession, TEXTS):
        found = work_table(rows.mapInArrow(_scan_batches, SCAN_DDL), "secret-spans")
    steps = found.select(F.explode("tested").alias("t")).groupBy("t.step").agg(F.sum("t.n").alias("n"), F.sum("t.chars").alias("chars"))
    steps = steps.collect()  # a row for each step: STEPS + 1 at most
    n = sum(r["n"] for r in steps)
    least = least_step({r["step"]: r["n"] for r in steps}, n, sum(r["chars"] for r in steps)) if n else STEPS + 1
    stand = F.filter("spans", lambda s: s["step"].isNull() | (s["step"] >= least))
    return found.select("doc_id", F.transform(stand, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def base_digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in scan(text) if k != "random").encode()).hexdigest()

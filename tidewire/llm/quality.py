"""Quality classifier: random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sample import bounded_ids
from ._shared import TEXTS, batch_rows, slices

#: Labelled texts of each label to fit on; rows of contexts that words share by their hash; numbers of a vector; of them in an index vector; window; units.
PER_LABEL, GROUPS, DIM, FILLED, WINDOW, UNITS = 1500, 1 << 14, 64, 6, 2, 32
#: Tokens whose vectors are held at once.
PIECE = 200_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: A text counts as good from this score on.
GOOD = 0.7


def tokens(text: str) -> list[str]:
    """Runs of letters, of digits and of signs, in lower case."""
    return TOKEN.findall(text.lower())


def _digests(words: list[str]) -> np.ndarray:
    """FILLED draws of 16 bits and a row's number for each word."""
    raw = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=2 * FILLED + 2).digest() for w in words)
    return np.frombuffer(raw, dtype="<u2").reshape(-1, FILLED + 1).astype(np.int64)


def word_vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' sparse ternary index vectors, drawn by their hashes (of equal places the last draw counts), and their rows."""
    h = _digests(words)
    out = np.zeros((len(words), DIM), dtype=np.int8)
    for j in range(FILLED):
        out[np.arange(len(words)), h[:, j] % DIM] = np.where(h[:, j] >> 15 & 1, 1, -1)
    return out, h[:, FILLED] % GROUPS


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _numbered(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of some texts as numbers, WINDOW times number 0 behind each text; where texts start; index vectors (that of 0 is 0) and rows by number."""
    numbers, gap = _Numbers({"": 0}), [""] * WINDOW
    size = [len(d) + WINDOW for d in docs]
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(chain(d, gap) for d in docs)), np.int64, sum(size))
    index, row = word_vectors(list(numbers))
    index[0] = 0
    return ids, np.cumsum([0, *size]), index, row


def _run_sums(x: np.ndarray, first: np.ndarray, few: int = 16) -> np.ndarray:
    """Sums of the runs of rows that begin at `first`: runs of few rows by their first rows together, their second ones, and so on."""
    size = np.diff(np.append(first, len(x)))
    out = x[first].astype(np.int64)
    short = np.flatnonzero((size > 1) & (size < few))
    for k in range(1, few - 1):
        short = short[size[short] > k]
        out[short] += x[first[short] + k]
    for i in np.flatnonzero(size >= few):
        out[i] = x[first[i] : first[i] + size[i]].sum(axis=0, dtype=np.int32)  # small numbers, PIECE rows at most
    return out


def contexts(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of some texts' words, and the sum of the index vectors of all neighbours of their words there."""
    ids, _, index, row = _numbered(docs)
    rows = np.unique(row[np.unique(ids[ids > 0])])
    out = np.zeros((len(rows), DIM), np.int64)
    for a in range(0, len(ids), PIECE):
        low, high = max(0, a - WINDOW), min(len(ids), a + PIECE + WINDOW)
        own = index[ids[low:high]]
        near = np.zeros_like(own)
        for k in range(1, WINDOW + 1):
            near[:-k] += own[k:]
            near[k:] += own[:-k]
        mine, near = ids[a : a + PIECE], near[a - low : a - low + PIECE]
        at = np.flatnonzero(mine)
        if not len(at):
            continue
        of = row[mine[at]]
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
        out[np.searchsorted(rows, of[order][first])] += _run_sums(near[at[order]], first)
    return rows, out


def corpus_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """What each row's words add to their index vectors for their neighbours over all texts, at unit length: GROUPS rows.

    Every word of every text counts, in the row that its hash names, so the table keeps its size however many words
    there are. Contexts are summed in each task and then by row; the driver gets GROUPS rows.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((GROUPS, DIM), np.int64)
        for batch in slices(batches):
            at, found = contexts([tokens(t) for t in batch.column(0).to_pylist()])
            total[at] += found
        at = np.flatnonzero(total.any(axis=1))
        columns = [pa.array(at, pa.int32()), *(pa.array(total[at, i], pa.int64()) for i in range(DIM))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", *(f"x{i}" for i in range(DIM))])

    names = [f"x{i}" for i in range(DIM)]
    parts = texts.mapInArrow(sums, "row int, " + ", ".join(f"{n} bigint" for n in names))
    got = parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    context = np.zeros((GROUPS, DIM))
    if got.num_rows:
        context[got.column("row").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], axis=1)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return (context / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """The mean vector of each text's words; 0 without words. A word's vector is its index vector at unit length and its row's context."""
    docs = [tokens(t) for t in texts]
    out = np.zeros((len(docs), DIM))
    if not docs:
        return out
    ids, starts, index, row = _numbered(docs)
    words = index / np.float32(np.sqrt(FILLED))
    if len(vectors):
        words[1:] += vectors[row[1:]]
    a = 0
    while a < len(docs):  # as many texts as PIECE tokens hold; of a longer one its words are counted
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE, side="right")) - 1)
        some = ids[starts[a] : starts[b]]
        if b == a + 1:
            out[a] = np.bincount(some, minlength=len(words)) @ words.astype(float)
        else:
            own = words[some]
            for i in range(a, b):
                own[starts[i] - starts[a] : starts[i + 1] - starts[a]].sum(axis=0, out=out[i])
        a = b
    return out / np.maximum(np.diff(starts) - WINDOW, 1)[:, None]


@dataclass
class Model:
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(DIM))
    scale: np.ndarray = field(default_factory=lambda: np.ones(DIM))
    layers: tuple | None = None
    temperature: float = 1.0
    base: float = 0.5

    def inputs(self, texts: list[str]) -> np.ndarray:
        return (pooled(texts, self.vectors) - self.mean) / self.scale

    def predict(self, texts: list[str]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.base)
        return 1 / (1 + np.exp(-np.clip(_logits(self.layers, self.inputs(texts)) / self.temperature, -40, 40)))


def _logits(layers: tuple, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def _fit_network(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 60) -> tuple:
    """Adam on the log loss with weight decay, both labels weighing the same."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], UNITS)), np.zeros(UNITS), rng.normal(0, np.sqrt(1 / UNITS), UNITS), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 64):
            i = order[a : a + 64]
            h = np.maximum(x[i] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) * weight[i] / len(i)
            dh = np.outer(d, p[2]) * (h > 0)
            t += 1
            for j, g in enumerate((x[i].T @ dh, dh.sum(0), h.T @ d, d.sum())):
                g = g + 1e-4 * p[j]
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def fit(x: np.ndarray, labels: np.ndarray, vectors: np.ndarray, seed: int = 5) -> Model:
    """A two-layer network over pooled vectors, and a temperature from a fifth set aside."""
    y = labels.astype(float)
    model = Model(vectors, x.mean(0), x.std(0) + 1e-3)
    x = (x - model.mean) / model.scale
    aside = np.random.default_rng(seed).permutation(len(x)) < len(x) / 5
    layers = _fit_network(x[~aside], y[~aside], seed) if 0 < y[~aside].mean() < 1 else None
    model.layers = layers or _fit_network(x, y, seed)
    z, ya = _logits(model.layers, x[aside]), y[aside]
    if len(z):
        loss = lambda t: np.mean(np.logaddexp(0, np.where(ya == 1, -1, 1) * z / t))
        model.temperature = float(min(np.geomspace(0.5, 8, 41), key=loss))
    return model


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL, seed: int = 9) -> Model:
    """Fit on at most 2 * per_label labelled texts of each label, none with crc32(id) mod 4 equal to 2; word vectors are from all texts."""
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    ids = bounded_ids(known, "id", "label", per_label, seed)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = own.join(F.broadcast(ids), "id").dropDuplicates(["id"])  # ids: bounded above
    kinds = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # two rows
    if len(kinds) < 2:
        return Model(base=float(max(kinds)) if kinds else 0.5)
    vectors = corpus_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # GROUPS vectors

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pooled(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "label", "x"])

    # A row of DIM numbers for each text of the sample.
    got = sample.select("id", "label", "text").mapInArrow(pool, "id bigint, label int, x array<double>").orderBy(F.xxhash64("id")).toArrow()
    return fit(np.array(got.column("x").to_pylist()), got.column("label").to_numpy(), vectors)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The quality of each whole text: doc_id, held_out, score (0 to 1), predicted (1 from 0.7).

    Null text is empty, and empty texts are scored like others. Without labels of both
    kinds the score is the share of label 1, or 0.5. Rows are scored one by one, so null
    ids, repeated rows and ties change nothing; no rows give no rows. Other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # GROUPS vectors

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        scores = [shared.value.predict([t or "" for t in texts.iloc[a : a + TEXTS]]) for a in range(0, len(texts), TEXTS)]
        return pd.Series(np.concatenate(scores) if scores else np.zeros(0))

    out = docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col)).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))

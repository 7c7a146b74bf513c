"""Language identification by a string kernel: Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sample import bounded_ids
from ._shared import TEXTS, batch_rows, slices

#: n-grams of the blended spectrum, and the places they are hashed to.
ORDERS, PLACES = (1, 2, 3, 4), 1 << 16
#: Labelled texts of a language to fit on, landmarks among them, ridge.
PER_CLASS, LANDMARKS, RIDGE = 300, 240, 0.01
UNKNOWN = "und"
#: An n-gram is a language's own if this share of its texts, and two texts, have it. What is cut off lies FAR
#: times as far from 1 as q, the least of MOST of the labelled texts set aside; short texts get SHORT / sqrt(n-grams) more.
#: The cut is never below FLOOR (foreign and shuffled texts lie under it), or q less NEAR where labelled texts do too.
#: A language with fewer learned texts than LEAST can't be told from an unlearned one: its texts stay.
OWN, MOST, FAR, SHORT, LEAST, FLOOR, NEAR = 0.01, 0.999, 7.0, 0.5, 50, 0.78, 0.05


def presence(text: str) -> np.ndarray:
    """Places of the n-grams that occur in a text, each once: the blended spectrum's presence."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    plain = (points < 97) | ((points > 122) & (points < 128))
    points[plain] = 32
    seen = np.zeros(PLACES, dtype=bool)
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(points) - n + 1] * np.uint64(0x100000001B3)) ^ points[n - 1 :] if n > 1 else points.copy()
        if not len(h):
            break
        if n in ORDERS:
            x = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0x632BE59BD9B4E019 % 2**64)
            seen[((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # places x classes: landmark features times dual weights
    bias: np.ndarray
    own: np.ndarray | None = None  # places x classes: whether a language's texts have the n-gram
    judged: np.ndarray | None = None  # whether a language has texts enough to say what is its own
    cut: float = 0.0

    def familiar(self, rows: list[np.ndarray], scores: np.ndarray) -> np.ndarray:
        """Whether each text's n-grams are those of its two best languages, as far as learned texts' are.

        Unlike the scores, whose best is 1 / classes at least, this falls for a text of no learned language.
        """
        return np.array([len(r) > 0 and (not self.judged[s.argmax()] or _shared(self.own, r, s) >= self.cut) for r, s in zip(rows, scores, strict=True)], dtype=bool)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Texts x classes: one product of the batch's kernel features with the weights."""
        out = np.tile(self.bias, (len(rows), 1))
        full = [i for i, r in enumerate(rows) if len(r)]
        if full and len(self.classes):
            sizes = np.array([len(rows[i]) for i in full])
            sums = np.add.reduceat(self.weights[np.concatenate([rows[i] for i in full])], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            out[full] += sums / np.sqrt(sizes)[:, None]
        return out


def _own(rows: list[np.ndarray], langs: list[str], classes: list[str]) -> np.ndarray:
    out = np.zeros((PLACES, len(classes)), dtype=bool)
    for k, c in enumerate(classes):
        of = [r for r, lang in zip(rows, langs, strict=True) if lang == c]
        if of:
            out[:, k] = np.bincount(np.concatenate(of), minlength=PLACES) >= max(2, OWN * len(of))
    return out


def _shared(own: np.ndarray, row: np.ndarray, scores: np.ndarray) -> float:
    """The share of a text's n-grams that either of its two best languages has (texts may mix them), and the allowance for its length."""
    best = np.argsort(-scores, kind="stable")[:2]
    return float((own[row, best[0]] | own[row, best[-1]]).mean()) + SHORT / np.sqrt(len(row))


def _calibrate(model: Model, rows: list[np.ndarray], langs: list[str]) -> Model:
    """Learn what is a language's own, and the cut from every fifth text against the other four fifths."""
    model.judged = np.array([langs.count(c) >= LEAST for c in model.classes])
    known = {c for c, j in zip(model.classes, model.judged, strict=True) if j}
    aside = [i for i in range(0, len(rows), 5) if len(rows[i]) and langs[i] in known]
    rest = [i for i in range(len(rows)) if i % 5]
    if aside and rest:
        own = _own([rows[i] for i in rest], [langs[i] for i in rest], model.classes)
        scores = model.scores([rows[i] for i in aside])
        shares = [_shared(own, rows[i], s) for i, s in zip(aside, scores, strict=True)]
        q = min(1.0, float(np.quantile(shares, 1 - MOST)))
        model.cut = min(max(1 - FAR * (1 - q), min(FLOOR, q - NEAR)), 1 - NEAR)
    model.own = _own(rows, langs, model.classes)
    return model


def _dense(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), PLACES), dtype=np.float32)
    for i, r in enumerate(rows):
        if len(r):
            out[i, r] = 1 / np.sqrt(len(r))
    return out


@dataclass
class Kernel:
    """The fit before it is folded: landmarks, K(L, L)^-1/2, and dual weights with the bias last."""

    marks: np.ndarray
    root: np.ndarray
    weights: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Kernel features K(x, L) K(L, L)^-1/2 times the weights; a text without n-grams has the bias."""
        z = np.concatenate([_dense(rows[a : a + 128]) @ self.marks.T for a in range(0, len(rows), 128)]).astype(np.float64) @ self.root
        return z @ self.weights[:-1] + self.weights[-1]


def fit_kernel(rows: list[np.ndarray], langs: list[str], classes: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel:
    """One-versus-rest kernel ridge regression on Nystroem features of the normalised presence kernel."""
    pick = np.unique(np.linspace(0, len(rows) - 1, min(landmarks, len(rows))).astype(int))
    marks = _dense([rows[i] for i in pick])
    vals, vecs = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = vals > 1e-6 * vals.max()
    root = vecs[:, good] / np.sqrt(vals[good])
    z = np.concatenate([_dense(rows[a : a + 128]) @ marks.T for a in range(0, len(rows), 128)]).astype(np.float64) @ root
    y = np.where(np.array(langs)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    share = np.array([1 / langs.count(c) for c in langs])
    share *= len(langs) / share.sum()
    zb = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    gram = (zb * share[:, None]).T @ zb + ridge * len(z) / 100 * np.eye(zb.shape[1])
    return Kernel(marks, root, np.linalg.solve(gram, (zb * share[:, None]).T @ y))


def fit(rows: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The kernel fit, folded. K(x, L) is linear in the presence of n-grams, so the product
    L' K(L, L)^-1/2 W, of all places and classes, is formed once; a batch's scores are its
    presence rows times that product, the same numbers as Kernel.scores() gives.
    """
    classes = sorted(set(langs))
    if not classes:
        return Model([], np.zeros((PLACES, 0), np.float32), np.zeros(0))
    k = fit_kernel(rows, langs, classes, landmarks, ridge)
    return _calibrate(Model(classes, (k.marks.T @ (k.root @ k.weights[:-1])).astype(np.float32), k.weights[-1]), rows, langs)


def _presence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [presence(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["lang", "places"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS, seed: int = 3) -> Model:
    """Fit on about per_class labelled texts of each language, twice as many at most (see _sample); all languages are learned.

    Only rows with text, a lang and crc32(id as text) mod 3 other than 1 are drawn from.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.where("lang IS NOT NULL AND id IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("id")))
    ids = bounded_ids(own, "id", "lang", per_class, seed).distinct()
    texts = own.join(F.broadcast(ids), ["id", "lang"], "left_semi").dropDuplicates(["id", "lang"])  # ids: bounded above
    with batch_rows(docs.sparkSession, TEXTS):
        got = texts.select("lang", "text", "id").orderBy(F.xxhash64("id")).select("lang", "text").mapInArrow(_presence_batches, "lang string, places array<int>").toArrow()
    rows = [np.array(p, dtype=np.int32) for p in got.column("places").to_pylist()]
    return fit(rows, got.column("lang").to_pylist())


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string")), F.lit(3)) == 1


def language(model: Model, docs: DataFrame, text: Column, rejects: bool = False) -> Column:
    """A struct (lang_pred, score) for each text: the best class, its margin mapped to 0..1.

    With `rejects`, a text that no learned language explains is `und` too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # places x classes: of fixed size

    def some(m: Model, texts: list[str | None]) -> pd.DataFrame:
        known = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        rows = [presence(t) if k else np.zeros(0, np.int32) for t, k in zip(texts, known, strict=True)]
        s = m.scores(rows)
        if rejects:
            known = np.array(known) & m.familiar(rows, s)
        best = s.argmax(axis=1)
        top = np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1)
        lang = [m.classes[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return pd.DataFrame({"lang_pred": lang, "score": np.where(known, top, 0.0)})

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        if not m.classes or not len(texts):
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
        return pd.concat([some(m, texts.iloc[a : a + TEXTS].tolist()) for a in range(0, len(texts), TEXTS)], ignore_index=True)

    return predict(text)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of each whole text: doc_id, held_out, lang_pred, score.

    lang_pred is a learned lang value; `und`, score 0, where the text is null or has no
    letter, or where nothing could be learned. A null id is held out of nothing and
    learned from never. Very long texts are read whole. Rows are scored one by one, so repeated rows agree; no rows give
    no rows. Other columns are not read.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = own.withColumn("p", language(model, docs, F.col("text")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text has a known language, with all their columns.

    Texts that are null, without a letter or of no learned language go; where no language
    was learned, all rows go. Repeated rows and null ids are judged like others; no rows
    give no rows. Columns may have any names.
    """
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    judged = rows.select("row", language(model, docs, F.col(f"row.{text_col}"), rejects=True).alias("judged"))
    return judged.where(F.col("judged.lang_pred") != UNKNOWN).select("row.*")

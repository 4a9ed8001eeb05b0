"""Language identification by sparse multinomial logistic regression.

A text's features are its character n-grams (one to three code points of the text in
lower case, letters only, everything else a blank), hashed into ``Settings.features``
cells, weighted by term and inverse document frequency and scaled to length 1.
Document frequencies are counted over all documents that may be learned from. The
weights are learned by follow-the-regularised-leader with elastic-net penalties, which
leaves most of them zero; a temperature, fitted on labelled documents that the weights
were not learned from, calibrates the probabilities.

The weights are fitted on a bounded sample: about ``Settings.texts`` labelled documents
of each language, fewer where there are very many languages, chosen by a hash of their
id; whole texts always. Every language is learned.

Defined results: texts that are null or have no letters are ``und`` with score 0; null
languages are not learned from; if nothing can be learned, every text is ``und``. An id
that occurs more than once is learned from, and predicted, once for each row. Columns
of other names are not read.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UND = "und"


@dataclass(frozen=True)
class Settings:
    features: int = 1 << 14
    #: About so many labelled documents of each language are learned from.
    texts: int = 1500
    #: With more languages, proportionally fewer of each, but not less than ``least``.
    languages: int = 256
    least: int = 32
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


class Letters:
    """Maps code points to lower-case letters, everything else to a blank."""

    def __init__(self):
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        self.table = table

    def __call__(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def cells(codes: np.ndarray, s: Settings) -> np.ndarray:
    """Counts of the hashed n-grams of a text's letters; n-grams of blanks alone are left out."""
    x = np.concatenate(([32], codes, [32])).astype(np.uint64)
    space = x == 32
    keep = ~(space & np.concatenate(([False], space[:-1])))
    x = x[keep]
    out = np.zeros(s.features, np.int64)
    h = np.zeros(len(x), np.uint64)
    for n in range(1, 4):
        k = len(x) - n + 1
        if k <= 0:
            break
        h = h[:k] * np.uint64(0x100000001B3) + x[n - 1 : n - 1 + k]
        g = h * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(n * 0x51ED)
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at = (g >> np.uint64(40)).astype(np.int64) % s.features
        out += np.bincount(at[x[:k] != 32] if n == 1 else at, minlength=s.features)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero cells and their weights, of length 1."""
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    norm = math.sqrt(float(v @ v))
    return at, v / norm if norm else v


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # cells by languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias

    def predict(self, codes: np.ndarray) -> tuple[str, float]:
        if not self.languages or not (codes != 32).any():
            return UND, 0.0
        p = softmax(self.logits(*weighted(cells(codes, self.settings), self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray, str, int]], idf: np.ndarray, s: Settings = Settings()) -> Model:
    """rows: (cells, weights, language, fold); fold 0 gives the weights, fold 1 the temperature."""
    languages = sorted({r[2] for r in rows})
    k = len(languages)
    model = Model(s, languages, idf, np.zeros((s.features, k)), np.zeros(k))
    if k < 2:
        return model
    # one more row, always 1, learns the bias
    z, n = np.zeros((s.features + 1, k)), np.zeros((s.features + 1, k))
    learn = [r for r in rows if r[3] == 0] or rows
    order = np.random.default_rng(5)
    for _ in range(s.epochs):
        for i in order.permutation(len(learn)):
            at, v, lang, _ = learn[i]
            at, v = np.append(at, s.features), np.append(v, 1.0)
            w = _lazy(z[at], n[at], s)
            g = softmax(v @ w)
            g[languages.index(lang)] -= 1
            step = v[:, None] * g[None, :]
            sigma = (np.sqrt(n[at] + step * step) - np.sqrt(n[at])) / s.alpha
            z[at] += step - sigma * w
            n[at] += step * step
    w = _lazy(z, n, s)
    model.weights, model.bias = w[:-1], w[-1]
    held = [r for r in rows if r[3] == 1] or learn
    logits = np.array([model.logits(at, v) for at, v, _, _ in held])
    truth = np.array([languages.index(r[2]) for r in held])
    best = min(np.geomspace(0.05, 20, 60), key=lambda t: _loss(logits / t, truth))
    model.temperature = float(best)
    return model


def _lazy(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """The weights that follow from the leader's sums: zero where the L1 penalty outweighs them."""
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    top = logits.max(axis=1, keepdims=True)
    return float((np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0] - logits[np.arange(len(truth)), truth]).mean())


def held_out(id: str):
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))


def frequencies(docs: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """In how many documents each cell occurs, and the number of documents with letters; counted by task first."""

    def run(batches):
        import pyarrow as pa

        letters, df, n = Letters(), np.zeros(s.features, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                c = letters(t or "")
                if (c != 32).any():
                    df += cells(c, s) > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most Settings.features + 1
    df = np.zeros(s.features, np.int64)
    total = 0
    for r in rows:
        if r["cell"] < 0:
            total = r["n"]
        else:
            df[r["cell"]] = r["n"]
    return df, total


def learn(docs: DataFrame, s: Settings = Settings()) -> Model:
    """docs(doc_id, text, lang): learns from documents that are not held out."""
    known = docs.where("lang is not null").where(~held_out("doc_id"))
    df, total = frequencies(known, s)
    idf = np.log((1 + total) / (1 + df)) + 1
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("m"))
    n = counts.count()
    if not n:
        return Model(s, [], idf, np.zeros((s.features, 0)), np.zeros(0))
    texts = max(s.least, s.texts * min(1.0, s.languages / n))
    point = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_003)) / 1_000_003
    fold = F.when(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4)) == 0, 1).otherwise(0)
    # a row a language is broadcast
    some = known.select("doc_id", "text", "lang", fold.alias("fold"), point.alias("point")).join(F.broadcast(counts), "lang").where(F.col("point") < texts / F.col("m"))

    def run(batches):
        import pyarrow as pa

        letters = Letters()
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                at, v = weighted(cells(letters(t or ""), s), idf)
                out.append((at.astype(np.int32), v.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for a, _ in out], pa.list_(pa.int32())), pa.array([v for _, v in out], pa.list_(pa.float32())), b.column(2), b.column(3)], names=["doc_id", "at", "v", "lang", "fold"])

    rows = some.select("doc_id", "text", "lang", "fold").mapInArrow(run, "doc_id long, at array<int>, v array<float>, lang string, fold int").orderBy("doc_id", F.xxhash64("at")).toArrow()
    data = [(np.asarray(a, np.int64), np.asarray(v, float), g, f) for a, v, g, f in zip(*(_values(rows.column(c)) for c in ("at", "v", "lang", "fold")), strict=True) if len(a)]
    return fit(data, idf, s)


def _values(column) -> list:
    import pyarrow as pa

    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return [x.values.to_numpy(zero_copy_only=False) for x in column]
    return column.to_pylist()


IDENTIFIED = "doc_id long, held_out boolean, lang_pred string, score double"


def identified(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", s: Settings = Settings()) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = learn(own, s)
    model.weights = model.weights.astype(np.float32)  # at most features times languages

    def run(batches):
        import pyarrow as pa

        letters = Letters()
        for b in batches:
            got = [model.predict(letters(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([g for g, _ in got]), pa.array([p for _, p in got], pa.float64())], names=[c.split()[0] for c in IDENTIFIED.split(", ")])

    return own.select("doc_id", "text", held_out("doc_id").alias("held_out")).mapInArrow(run, IDENTIFIED)

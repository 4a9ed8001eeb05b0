"""Toxicity by compression distance.

Two zstandard dictionaries are trained by zstandard's own trainer, one on toxic, one on
ordinary text: on every occurrence of the words that hold a telling byte string (one
whose presence in texts of the class is no chance, by a likelihood ratio). A second pair
is trained on pairs of adjacent words that tell. A text is cut into
windows of ``window_words``; a window of ``phrase_words`` is laid around each telling
pair. Each is compressed with either dictionary, and the difference of the two lengths
is looked up in a table of log likelihood ratios, by its share of the window's length
too, which is calibrated on labelled texts that the dictionaries were not trained on. A
logistic function, fitted on the same texts, turns the sums into a score of 0 to 1.

Where the trainer refuses (it wants a few samples), the samples themselves are the
dictionary. Equal windows of a block of texts are compressed once.

Labelled texts are learned from whole, at most ``Settings.texts`` of each class,
chosen by a hash of their id; scores are those of whole texts.

Defined results: a null text is empty; texts without words score as windowless texts do;
null labels are not learned from; an id labelled twice counts as toxic if one label
says so; if a class has no labelled texts, every score is the share of toxic labels.
Columns of other names are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A

#: Begins every window, so that a window is never too short to be compressed.
ANCHOR = bytes(range(1, 9)) * 2
#: Ends every window: no match begins in the last bytes that are compressed.
TAIL = bytes(8)
PRIOR = 8.0
#: Windows of a generation that a task remembers.
REMEMBERED = 500_000
#: Bytes of texts that are scored at a time.
BLOCK = 1 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class Settings:
    #: At most about so many labelled texts of each class are learned from.
    texts: int = 2500
    window_words: int = 1
    #: Bytes of a window; a longer one is cut.
    window_bytes: int = 256
    #: Lengths of the byte strings inside words (a blank on either side) that may tell.
    grams: tuple[int, ...] = (4, 5, 6, 7, 8, 9, 10)
    #: Texts of the class that hold a telling byte string or pair of words, at least.
    support: int = 4
    #: A byte string tells from a likelihood ratio, in nats, of the logarithm of the number of strings tested, and this.
    gain: float = 0.0
    #: Likelihood ratio, in nats, from which a pair of words tells.
    phrase_gain: float = 6.0
    phrase_words: int = 4
    #: Bytes of a trained dictionary.
    dictionary: int = 8000
    level: int = 12
    clip: int = 14
    threshold: float = 0.7


def words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def _windows(text: bytes, s: Settings) -> list[bytes]:
    w, n = words(text), s.window_words
    out = []
    for i in range(0, len(w), n):
        x = b" " + b" ".join(w[i : i + n]) + b" "
        out += [x[k : k + s.window_bytes] for k in range(0, len(x), s.window_bytes)]
    return out


def _ratio(n, m, na: int, nb: int):
    """Likelihood ratio, in nats, of what is in n of na texts of a class and in m of nb others."""
    p, q, r = n / na, (m + 0.5) / nb, (n + m) / (na + nb)
    return np.where(p >= 3 * q, n * np.log(p / r) + m * np.log(q / r), 0.0)


class Grams:
    """Byte strings of one length inside the words of texts, as hashes; each word has a blank on either side."""

    def __init__(self, texts: list[bytes], n: int):
        self.n = n
        # one blank between words and two between texts, so that no string spans texts
        self.blocks = list(A.blocks([b" " + b" ".join(words(t)) + b" " for t in texts]))

    def __iter__(self):
        """(hash, text's number, where the string begins, the block's bytes) for each block."""
        for lo, _, buf, starts in self.blocks:
            k = len(buf) - self.n + 1
            if k <= 0:
                continue
            h = np.zeros(k, np.uint64)
            inner = np.zeros(k, bool)
            for j in range(self.n):
                c = buf[j : j + k]
                h = h * np.uint64(0xD6E8FEB86659FD93) + c
                inner |= (c == 10) | ((c == 32) if 0 < j < self.n - 1 else False)
            at = np.flatnonzero(~inner)
            yield A.mix64(h[at]), lo + np.searchsorted(starts, at, "right") - 1, at, buf

    def counts(self, of: np.ndarray | None = None, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, of the given sorted ones only, and in how many texts each is."""
        out = []
        for h, owner, _, _ in self:
            if of is not None:
                ok = member(of, h)
                h, owner = h[ok], owner[ok]
            if len(h):
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                out.append(h[np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))])
        h, n = np.unique(np.concatenate(out), return_counts=True) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))
        return h[n >= least], n[n >= least]


def member(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(h), bool)
    at = np.searchsorted(sorted_hashes, h)
    return sorted_hashes[np.minimum(at, len(sorted_hashes) - 1)] == h


def telling_words(own: list[bytes], other: list[bytes], s: Settings) -> list[bytes]:
    """Every occurrence in texts of ``own`` of a word that holds a telling byte string."""
    hits: dict[tuple[int, int], bytes] = {}
    for n in s.grams:
        grams = Grams(own, n)
        h, times = grams.counts(least=s.support)
        k, m = Grams(other, n).counts(h)
        against = np.zeros(len(h), np.int64)
        against[np.searchsorted(h, k)] = m
        best = h[_ratio(times, against, len(own) + 1, len(other) + 1) >= s.gain + math.log(len(h) + 1)]
        for block, (h, _, at, buf) in enumerate(grams):
            blank = np.flatnonzero((buf == 32) | (buf == 10))
            for x in at[member(best, h)].tolist():
                i = int(np.searchsorted(blank, x, "right"))
                a, b = (int(blank[i - 1]) if i else -1), int(blank[i]) if i < len(blank) else len(buf)
                hits[block, a] = buf[a + 1 : b].tobytes()
    return [b" " + w + b" " for _, w in sorted(hits.items())]


def trained(samples: list[bytes], s: Settings) -> bytes:
    """A dictionary by zstandard's trainer; where it refuses, of the samples themselves, the most frequent last."""
    import zstandard as Z

    try:
        return Z.train_dictionary(s.dictionary, samples, level=s.level).as_bytes()
    except Z.ZstdError:
        some = sorted(Counter(samples).items(), key=lambda x: (x[1], x[0]))
        return b"".join(x for x, _ in some)[-s.dictionary :].rjust(16, b"\0")


def compressor(dictionary: bytes, s: Settings):
    """A function from a window to its compressed length."""
    import zstandard as Z

    p = Z.ZstdCompressionParameters.from_level(s.level, write_content_size=0, write_dict_id=0, format=Z.FORMAT_ZSTD1_MAGICLESS)
    x = Z.ZstdCompressionDict(dictionary)
    x.precompute_compress(compression_params=p)
    f = Z.ZstdCompressor(dict_data=x, compression_params=p).compress
    return lambda w: len(f(ANCHOR + w + TAIL))


def train_dictionary(own: list[bytes], other: list[bytes], s: Settings) -> bytes:
    """Of the class ``own``, from each occurrence of its telling words."""
    return trained(telling_words(own, other, s), s)


def pairs(w: list[bytes]) -> list[bytes]:
    return [x + b" " + y for x, y in zip(w, w[1:], strict=False)]


def train_phrases(own: list[bytes], other: list[bytes], s: Settings) -> tuple[bytes, list[bytes]]:
    """Pairs of adjacent words of the class ``own``: a dictionary of those that tell, and the pairs."""
    seen = [Counter(x for t in texts for x in set(pairs(words(t)))) for texts in (own, other)]
    known = sorted(x for x, n in seen[0].items() if n >= s.support)
    n, m = (np.array([c.get(x, 0) for x in known], float) for c in seen)
    best = [x for x, g in zip(known, _ratio(n, m, len(own) + 1, len(other) + 1), strict=True) if g >= s.phrase_gain] if known else []
    return trained([b" " + x + b" " for x in best for _ in range(seen[0][x])], s), best


def _word_hashes(x: list[bytes]) -> np.ndarray:
    """Of each single word, as A.span_hashes gives it in any text."""
    out = np.empty(len(x), np.uint64)
    for lo, hi, buf, starts in A.blocks(x):
        out[lo:hi] = A.span_hashes(buf, starts[:-1], starts[1:] - 1)
    return out


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return A.mix64(first * np.uint64(0xD6E8FEB86659FD93) + second)


class Differences:
    """Classes of windows by their length under the ordinary dictionary less that under the toxic one, alone and as a share of the window; those of words, then those of phrases."""

    SHARES = 5

    def __init__(self, toxic: bytes, ordinary: bytes, s: Settings, phrases: tuple[bytes, bytes, list[bytes]] = (bytes(16), bytes(16), [])):
        self.s = s
        self.bins = (2 * s.clip + 1) * self.SHARES
        # classes of windows seen of late: a full generation becomes the older one, so frequent windows stay
        self.known: dict[int, int] = {}
        self.older: dict[int, int] = {}
        split = [p.split(b" ") for p in phrases[2]]
        a, b = (_word_hashes([x[k] for x in split]) for k in (0, 1)) if split else (np.empty(0, np.uint64),) * 2
        self.telling = np.unique(_pair_hashes(a, b))
        self.of_words = [compressor(d, s) for d in (ordinary, toxic)]
        self.of_phrases = [compressor(d, s) for d in (phrases[1], phrases[0])]

    def of_window(self, w: bytes, lengths: list) -> int:
        a, b = (f(w) for f in lengths)
        share = min(self.SHARES - 1, max(0, (a - b) * self.SHARES // len(w)))
        return (max(-self.s.clip, min(self.s.clip, a - b)) + self.s.clip) * self.SHARES + share

    def _remembered(self, key: int, w: bytes) -> int:
        c = self.known.get(key)
        if c is None:
            c = self.older.get(key)
            if c is None:
                c = self.of_window(w, self.of_words)
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[key] = c
        return c

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """A row a text: how many of its windows fall into each class."""
        out = np.zeros((len(texts), 2 * self.bins), np.int64)
        for lo, hi, buf, starts in A.blocks(texts, BLOCK):
            buf = A.lower_ascii(buf)
            ws, we = A.word_bounds(buf)
            if not len(ws):
                continue
            n = hi - lo
            owner = np.searchsorted(starts, ws, "right") - 1
            h = A.span_hashes(buf, ws, we)
            if self.s.window_words == 1 and int((we - ws).max()) + 2 <= self.s.window_bytes:
                _, at, back = np.unique(h, return_index=True, return_inverse=True)
                data = buf.tobytes()
                classes = np.array([self._remembered(k, b" " + data[i:j] + b" ") for k, i, j in zip(h[at].tolist(), ws[at].tolist(), we[at].tolist(), strict=True)], np.int64)[back]
                out[lo:hi, : self.bins] = np.bincount(owner * self.bins + classes, minlength=n * self.bins).reshape(n, self.bins)
            else:
                for k, t in enumerate(texts[lo:hi]):
                    for w in _windows(t, self.s):
                        out[lo + k, self._remembered(hash(w), w)] += 1
            self._phrases(out[lo:hi, self.bins :], buf, ws, we, owner, h)
        return out

    def _phrases(self, out: np.ndarray, buf: np.ndarray, ws: np.ndarray, we: np.ndarray, owner: np.ndarray, h: np.ndarray) -> None:
        """As of the words; places without a telling pair count as windows without a difference."""
        if not len(self.telling):
            return
        first = np.searchsorted(owner, np.arange(len(out) + 1))
        hits = np.flatnonzero((owner[1:] == owner[:-1]) & member(self.telling, _pair_hashes(h[:-1], h[1:])))
        for i in hits.tolist():
            o = owner[i]
            lo = max(int(first[o]), i - (self.s.phrase_words - 2) // 2)
            hi = min(int(first[o + 1]), lo + self.s.phrase_words)
            w = b" " + b" ".join(buf[a:b].tobytes() for a, b in zip(ws[lo:hi].tolist(), we[lo:hi].tolist(), strict=True)) + b" "
            out[o, self.of_window(w[: self.s.window_bytes], self.of_phrases)] += 1
        out[:, self.s.clip * self.SHARES] += np.maximum(0, np.diff(first) - 1 - np.bincount(owner[hits], minlength=len(out)))


@dataclass
class Model:
    settings: Settings
    toxic: bytes
    ordinary: bytes
    table: np.ndarray
    weights: np.ndarray  # of 1, and for words and phrases the sum and the sum over the root of the windows
    phrases: tuple[bytes, bytes, list[bytes]]

    def scorer(self):
        """A function from texts to their scores."""
        diff = Differences(self.toxic, self.ordinary, self.settings, self.phrases)

        def score(texts: list[bytes]) -> list[float]:
            return [1 / (1 + math.exp(-max(-35.0, min(35.0, float(_features(c, self.table) @ self.weights))))) for c in diff(texts)]

        return score


def _features(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = [1.0]
    for c, t in zip(np.split(counts, 2), np.split(table, 2), strict=True):
        total = float(c @ t)
        out += [max(-20.0, min(60.0, total)), max(-5.0, min(15.0, total / math.sqrt(c.sum() + 1)))]
    return np.array(out)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method, lightly penalised."""
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.5] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(rows: list[tuple[bytes, int, int]], weight: dict[int, float], s: Settings = Settings()) -> Model:
    """rows: (text, label, fold 0 or 1); fold 0 trains the dictionaries, fold 1 calibrates. weight: labelled texts that one learned text of the class stands for."""
    part = {(y, f): [t for t, a, b in rows if a == y and b == f] for y in (0, 1) for f in (0, 1)}
    toxic, ordinary = train_dictionary(part[1, 0], part[0, 0], s), train_dictionary(part[0, 0], part[1, 0], s)
    (a, of_toxic), (b, of_ordinary) = train_phrases(part[1, 0], part[0, 0], s), train_phrases(part[0, 0], part[1, 0], s)
    phrases = (a, b, sorted({*of_toxic, *of_ordinary}))
    diff = Differences(toxic, ordinary, s, phrases)
    share = weight.get(1, 0.0) * len(part[1, 1]) + 0.5, weight.get(0, 0.0) * len(part[0, 1]) + 0.5
    if not part[1, 1] or not part[0, 1]:
        return Model(s, toxic, ordinary, np.zeros(2 * diff.bins), np.array([math.log(share[0] / share[1]), 0.0, 0.0, 0.0, 0.0]), phrases)
    held = np.concatenate([diff(part[y, 1]) for y in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(part[0, 1]), len(part[1, 1])])
    sums = [held[y == c].sum(axis=0).astype(float) for c in (0, 1)]
    table = np.concatenate([_ratios(*x) for x in zip(*(np.split(t, 2) for t in sums), strict=True)])
    x = np.array([_features(c, table) for c in held])
    return Model(s, toxic, ordinary, table, _logistic(x, y, np.array([weight.get(int(a), 1.0) for a in y])), phrases)


def _ratios(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log likelihood ratios of the classes of windows, shrunk as if PRIOR windows more had been seen in both in equal shares; ordinary windows count little."""
    both = (ordinary + toxic) / max(1.0, (ordinary + toxic).sum())
    a, b = ((t + PRIOR * both) / (t.sum() + PRIOR) for t in (toxic, ordinary))
    out = np.zeros(len(both))
    ok = both > 0
    out[ok] = np.clip(np.log(a[ok] / b[ok]), -0.3, 6.0)
    return out


def held_out(id: str):
    return F.crc32(F.col(id).cast("string")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic): learns from labelled texts that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)").where(~held_out("doc_id"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for y, n in counts.items():
        rate = F.when(F.col("toxic") == y, min(1.0, s.texts / n)).otherwise(rate)
    point = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) / 1_000_003
    fold = F.when(F.pmod(F.xxhash64("doc_id", F.lit(18)), F.lit(5)) < 3, 0).otherwise(1)
    # about twice Settings.texts ids, whatever the number of labels
    some = known.where(point < rate).select("doc_id", "toxic", fold.alias("fold"))
    rows = docs.join(F.broadcast(some), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "fold", "doc_id").orderBy("doc_id", "text").collect()
    learned = Counter(int(r["toxic"]) for r in rows)
    return fit([(r["text"].encode(), int(r["toxic"]), int(r["fold"])) for r in rows], {y: counts[y] / max(1, learned[y]) for y in counts}, s)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = learn(own, labels.select("doc_id", "toxic"), s)

    def run(batches):
        import pyarrow as pa

        score = model.scorer()
        for b in batches:
            values = score(A.as_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(values, pa.float64()), pa.array([int(v >= s.threshold) for v in values], pa.int32())], names=[c.split()[0] for c in SCORED.split(", ")])

    return own.select("doc_id", "text", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")).mapInArrow(run, SCORED)

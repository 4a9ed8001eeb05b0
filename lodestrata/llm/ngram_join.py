"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct shingles of five words. Sets fall into bands of
sizes whose ends differ by the square of the similarity's factor, so similar sets are in
one band or in neighbouring ones; each set signs for its own band, and for the next one
if a set of that band can be similar to it. A set of ``s`` elements differs from any
similar one that is not smaller in at most ``differ(s)`` elements; ``k`` is that bound
for the largest of the band. The domain of shingles is divided into ``n1`` parts, each
of these into ``n2`` subparts; a part in which two sets differ in at most ``k2`` elements
agrees in the contents of some choice of ``n2 - k2`` of its subparts. The signatures are
the contents of every choice.

How many parts, subparts and choices is a matter of cost (``parts_for``): with large k
each part has two subparts and either of them is a choice, which gives the fewest
signatures a set, about one for each element that may differ. There a set signs its
first halves only, in the order of the domain: ``differ(s) + 1 + margin`` that are not
empty. Of a similar pair, the set that ends first has so many of them, at most
``differ(s)`` of which the other doesn't share, and the other signs all of these, too.

Empty contents would be shared by all sets that miss a subpart. They need a signature
only if too few of the set's parts are certain not to be empty after dropping; all
others agree with every similar set in some part that is not.

Each group of signatures (of one band) has more shared ones than it needs, ``spare`` at
least, so each set may leave out as many of its most frequent ones (the same order for
all sets) and still meets every similar one: passages that many documents share make no
candidates. Sets that can be similar to equal ones only sign nothing: equal sets are
found by a hash of the set.

All candidates are verified exactly (setjoin). Elements are 64-bit hashes of shingles.

Defined results: null texts and texts without words have no shingles, are linked with
nothing, and are their own component; texts of fewer than five words have one shingle,
the whole sequence; rows with one id count as one document that has the links of each
of them; rows without an id are linked with nothing and have no component. Columns
other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _arrays as A
from ._cluster import discard, fresh_name, met, written
from .setjoin import bucket_links, components

WORDS = 5
PERCENT = 80
#: Sets that a task remembers so as to sign equal ones once; afterwards it starts anew.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Parts:
    n1: int
    n2: int
    k2: int
    margin: int

    @property
    def choices(self) -> np.ndarray:
        """n2 rows, a column for each choice of n2 - k2 subparts."""
        cols = list(combinations(range(self.n2), self.n2 - self.k2))
        out = np.zeros((self.n2, len(cols)), np.uint64)
        for c, members in enumerate(cols):
            out[list(members), c] = 1
        return out


def parts_for(k: int) -> Parts:
    """Parts for sets that differ in at most k elements."""
    if k <= 3:
        return Parts(1, k + 3, k, 0)
    if k <= 7:
        return Parts(ceil((k + 1) / 2) + 2, 4, 1, 2)
    margin = ceil(0.12 * (k + 1)) + 3
    return Parts(ceil((k + 1 + margin) / 2), 2, 1, margin)


class Signer:
    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.first = [1]  # smallest size of each band
        self.known: dict[int, tuple[Parts, np.ndarray]] = {}

    def differ(self, size: int) -> int:
        """In how many elements a set and a similar one that is not smaller differ at most."""
        # 100 |A & B| >= p |A | B| means |A ^ B| <= (100 - p) / (100 + p) (|A| + |B|)
        return (size + size * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def band(self, size: int) -> int:
        while self.first[-1] <= size:
            self.first.append(self.last(len(self.first) - 1) + 1)
        return int(np.searchsorted(self.first, size, "right")) - 1

    def last(self, band: int) -> int:
        return self.first[band] * 10000 // self.percent**2

    def parts(self, band: int) -> tuple[Parts, np.ndarray]:
        if band not in self.known:
            p = parts_for(self.differ(self.last(band)))
            self.known[band] = (p, p.choices)
        return self.known[band]

    def signatures(self, items: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """items: sorted distinct uint64. For the set's band and, where needed, the next: signatures, and how many of them a similar set shares at least besides one."""
        size = len(items)
        if not self.differ(size):
            return []
        own = self.band(size)
        reach = self.band(size * 100 // self.percent)
        return [self._of_band(items, b) for b in range(own, reach + 1)]

    def _of_band(self, items: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        p, choices = self.parts(band)
        differ = self.differ(len(items))
        start = np.uint64((band + 1) * 0x2545F4914F6CDD1D % 2**64)
        if p.n2 == 2:
            n = 2 * p.n1
            half = ((items >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)  # grows with the element
            at = np.concatenate(([0], np.flatnonzero(half[1:] != half[:-1]) + 1))
            wanted = differ + 1 + p.margin
            if len(at) > wanted:
                items, at = items[: at[wanted]], at[:wanted]
            held = half[at]
            out = A.mix64(np.add.reduceat(A.mix64(items + np.uint64(0x51ED270B0A1F39C1)), at) + A.mix64(start + held))
            spare = len(held) - differ - 1
            if spare < 0:
                out = np.concatenate((out, A.mix64(A.mix64(start + np.setdiff1d(np.arange(n, dtype=np.uint64), held)))))
            return out, max(spare, 0)
        value = A.mix64(items + np.uint64(0x51ED270B0A1F39C1))
        part = ((items >> np.uint64(32)) * np.uint64(p.n1)) >> np.uint64(32)
        sub = ((A.mix64(items) >> np.uint64(32)) * np.uint64(p.n2)) >> np.uint64(32)
        cell = (part * np.uint64(p.n2) + sub).astype(np.int64)
        sums = np.zeros(p.n1 * p.n2, np.uint64)
        np.add.at(sums, cell, value)
        counts = np.bincount(cell, minlength=p.n1 * p.n2).reshape(p.n1, p.n2)
        total = (sums.reshape(p.n1, p.n2)[:, :, None] * choices[None]).sum(axis=1, dtype=np.uint64).ravel()
        out = A.mix64(total + A.mix64(start + np.arange(p.n1 * choices.shape[1], dtype=np.uint64)))
        filled = (counts @ choices.astype(np.int64)).ravel() > 0
        spare = int(((counts > 0).sum(axis=1) > p.k2).sum()) - differ // (p.k2 + 1) - 1
        return (out if spare < 0 else out[filled]), max(spare, 0)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    out: list[np.ndarray] = []
    for lo, hi, buf, starts in A.blocks(texts):
        buf = A.lower_ascii(buf)
        ws, we = A.word_bounds(buf)
        owner = np.searchsorted(starts, ws, "right") - 1
        h = A.span_hashes(buf, ws, we)
        tri, at = A.windows(h, owner, WORDS)
        edges = np.searchsorted(owner[at], np.arange(hi - lo + 1))
        firsts = np.searchsorted(owner, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            if edges[k] < edges[k + 1]:
                out.append(np.unique(tri[edges[k] : edges[k + 1]]))
            elif firsts[k] < firsts[k + 1]:
                few = h[firsts[k] : firsts[k + 1]]
                out.append(A.windows(few, np.zeros(len(few), np.int64), len(few))[0])
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    both = np.array([A.mix64(s).sum(dtype=np.uint64), A.mix64(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64)], np.uint64)
    return tuple(both.view(np.int64).tolist())


def _sized(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> id, n (set size), k1, k2 (the set's hash)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = shingle_sets(A.as_bytes(b.column(1)))
            keys = [_hash(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64())], names=["id", "n", "k1", "k2"])

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long")


def _signed(docs: DataFrame, percent: int) -> DataFrame:
    """docs(id, text) -> sig, id, tag: a row for each signature; a task signs equal sets once."""

    def run(batches):
        import pyarrow as pa

        signer, seen = Signer(percent), set()
        for b in batches:
            ids, sets = b.column(0).to_pylist(), shingle_sets(A.as_bytes(b.column(1)))
            for lo in range(0, len(ids), 500):
                sigs, owner, tags = [], [], []
                for i, s in zip(ids[lo : lo + 500], sets[lo : lo + 500], strict=True):
                    if not len(s) or (key := _hash(s)) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    for side, (x, spare) in enumerate(signer.signatures(s)):
                        sigs.append(x.view(np.int64))
                        owner.append((i, len(x)))
                        tags.append(2 * spare + side)
                if sigs:
                    n = [k for _, k in owner]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.repeat(np.array([i for i, _ in owner], np.int64), n)), pa.array(np.repeat(np.array(tags, np.int32), n))], names=["sig", "id", "tag"])

    return docs.where("id is not null").mapInArrow(run, "sig long, id long, tag int")


def _texts_of(docs: DataFrame):
    """The texts of the asked documents; smaller on their way than their sets."""
    return lambda ids: met(docs, ids, "id", "left_semi").select("id", F.col("text").alias("items"))


def elements(column) -> list[np.ndarray]:
    return shingle_sets(A.as_bytes(column))


def joined(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row a document: id, n (set size), component."""
    own = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sizes = written(_sized(own))
    held = sizes.where("n > 0 and id is not null")
    first = held.groupBy("n", "k1", "k2").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").drop("z")
    equal = held.join(first, ["n", "k1", "k2"]).where("id <> a").select("a", F.col("id").alias("b"))
    signed = written(_signed(own, percent), codec="lz4")
    links = bucket_links(signed, _texts_of(own), elements, percent, extra=equal)
    discard(signed)
    comp = components(links)
    return sizes.select("id", "n").join(comp, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest id of their component, with their columns unchanged; of repeated rows one stays."""
    key, nth = fresh_name(docs, "__gone"), fresh_name(docs, "__nth")
    gone = joined(docs, id, text, percent).where("id <> component").select(F.col("id").alias(key)).distinct()
    same = Window.partitionBy(F.col(f"`{id}`"), F.col(f"`{text}`")).orderBy(F.lit(1))
    kept = docs.join(gone, F.col(f"`{id}`") == F.col(key), "left_anti")
    return kept.withColumn(nth, F.row_number().over(same)).where((F.col(nth) == 1) | F.col(f"`{id}`").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])

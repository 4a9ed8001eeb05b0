"""Document fingerprints: a quartile digest of hashed byte triplets.

Every window of five bytes counts six of its triplets, hashed into 128 buckets. The
digest holds, for each bucket, which quarter of the bucket counts it falls in, and
before that the length on a logarithmic scale and two ratios of the quartiles. The
difference of two digests adds up the distances of those codes; it is bounded by
``BOUND``, and the likeness is 1 less its share of the bound.

Defined results: null is an empty text; equal texts have equal digests; texts of
fewer than five bytes have no triplets and differ by their length only.
``with_successor_edits`` orders rows by descending id, null last, equal ids by text;
the row after the last is the first, so one row alone is followed by itself. Other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._cluster import partitions

BUCKETS = 128
#: The offsets of the triplets in a window of five bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Distance of two quartile codes by their difference.
STEP = np.array([0, 1, 2, 6])
BOUND = 256


def digests(texts: list[bytes]) -> np.ndarray:
    """One row a text of 3 + BUCKETS codes: length, two ratios, quartile of each bucket."""
    out = np.zeros((len(texts), 3 + BUCKETS), np.uint8)
    for lo, hi, buf, starts in A.blocks(texts):
        n = hi - lo
        lens = np.diff(starts) - 1
        owner = np.repeat(np.arange(n), lens + 1)
        ok = np.flatnonzero(np.arange(len(buf)) - starts[owner] <= lens[owner] - 5)
        counts = np.zeros(n * BUCKETS, np.int64)
        if len(ok):
            base = owner[ok] * BUCKETS
            wide = buf.astype(np.uint32)
            shifted = [wide[k:][ok] if k == 0 else np.concatenate((wide[k:], np.zeros(k, np.uint32)))[ok] for k in range(5)]
            for salt, (i, j, k) in enumerate(TRIPLETS):
                x = shifted[i] | shifted[j] << np.uint32(8) | shifted[k] << np.uint32(16)
                x = (x + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x85EBCA77)
                counts += np.bincount(base + (x >> np.uint32(25)), minlength=n * BUCKETS)
        counts = counts.reshape(n, BUCKETS)
        q = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        out[lo:hi, 0] = np.minimum(255, np.round(12 * np.log2(1 + lens)))
        top = np.maximum(q[:, 2], 1)
        out[lo:hi, 1] = q[:, 0] * 100 // top % 16
        out[lo:hi, 2] = q[:, 1] * 100 // top % 16
        for k in range(3):
            out[lo:hi, 3:] += counts > q[:, k : k + 1]
    return out


def encode(codes: np.ndarray) -> list[str]:
    """Hexadecimal text: one byte of length, a byte of ratios, four buckets a byte."""
    body = codes[:, 3:].reshape(len(codes), BUCKETS // 4, 4)
    packed = body[:, :, 0] << 6 | body[:, :, 1] << 4 | body[:, :, 2] << 2 | body[:, :, 3]
    rows = np.concatenate((codes[:, :1], codes[:, 1:2] << 4 | codes[:, 2:3], packed), axis=1).astype(np.uint8)
    return [r.tobytes().hex() for r in rows]


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    body = np.stack([raw[2:] >> 6, raw[2:] >> 4 & 3, raw[2:] >> 2 & 3, raw[2:] & 3], axis=1).ravel()
    return np.concatenate(([raw[0], raw[1] >> 4, raw[1] & 15], body)).astype(np.uint8)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded differences of two arrays of codes, row by row."""
    gap = np.abs(a.astype(np.int64) - b)
    ratio = np.minimum(gap[:, 1:3], 16 - gap[:, 1:3]).sum(axis=1)
    return np.minimum(BOUND, STEP[gap[:, 3:]].sum(axis=1) + gap[:, 0] + ratio)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - differences(a, b) / BOUND


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Adds the digest of each whole text."""

    @F.pandas_udf("string")
    def digest(s):
        import pandas as pd

        return pd.Series(encode(digests([(t or "").encode() for t in s])))

    return docs.withColumn(into, digest(F.col(text)))


def _rank_from(bounds: list, key: str):
    """How many of the descending bounds lie above the key: a search in two levels, so many bounds stay cheap."""
    if not bounds:
        return F.lit(0)
    k = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*[F.lit(b) for b in bounds[::k]])
    every = F.array(*[F.lit(b) for b in bounds])
    c = F.size(F.filter(coarse, lambda b: b > F.col(key)))
    rest = F.size(F.filter(F.slice(every, F.greatest(c - 1, F.lit(0)) * k + 1, k), lambda b: b > F.col(key)))
    return F.when(c == 0, F.lit(0)).otherwise((c - 1) * k + rest)


def successors(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs(id long, text string): rows dealt to ranges of descending id, each range ended by a copy of the row after it.

    The driver sees a bounded number of ids, one or two for each range. Gives the
    rows, sorted within their partitions by range, copy, id and text.
    """
    n = partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10000).alias("c")).first()["c"] if n > 1 else None
    bounds = sorted(set(cuts or []), reverse=True)
    ranged = docs.withColumn("range", F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(_rank_from(bounds, "id")).cast("int"))
    heads = {r["range"]: r["head"] for r in ranged.groupBy("range").agg(F.max("id").alias("head")).collect()}
    held = sorted(heads)
    before = {r: held[i - 1] for i, r in enumerate(held)}  # the first range's head ends the last range
    size = len(bounds) + 2
    head = F.array(*[F.lit(heads.get(r)).cast("long") for r in range(size)])
    prev = F.array(*[F.lit(before.get(r, 0)).cast("int") for r in range(size)])
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("copy"))
    copy = F.struct(prev[F.col("range")].alias("range"), F.lit(1).alias("copy"))
    places = F.when(F.col("id").eqNullSafe(head[F.col("range")]), F.array(own, copy)).otherwise(F.array(own))
    dealt = ranged.select("id", "text", F.explode(places).alias("p")).select("id", "text", "p.range", "p.copy")
    return dealt.repartition(n, "range").sortWithinPartitions("range", "copy", F.col("id").desc_nulls_last(), "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_successor_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints each text and the same text with its last half replaced from the next document's beginning."""
    own = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        waiting = None  # (range, id, text, codes) of the row whose successor is to come
        for b in batches:
            ranges, copies, ids, texts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("range", "copy", "id", "text"))
            codes = digests([t.encode() for t in texts])
            done = []  # (id, text, codes, next text, next codes)
            for k, (r, c, i, t) in enumerate(zip(ranges, copies, ids, texts, strict=True)):
                if waiting is not None and waiting[0] == r:
                    done.append((*waiting[1:], t, codes[k]))
                waiting = (r, i, t, codes[k]) if c == 0 else None
            if not done:
                continue
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for _, t, _, u, _ in done]
            raw = [e.encode() for e in edited]
            first, after, third = np.stack([d[2] for d in done]), digests(raw), np.stack([d[4] for d in done])
            cols = [
                pa.array([d[0] for d in done], pa.int64()),
                pa.array([len(d[1]) for d in done], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in raw]),
                pa.array(encode(first)),
                pa.array(encode(after)),
                pa.array(likeness(first, after)),
                pa.array(likeness(first, third)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in EDITED.split(", ")])

    return successors(own).mapInArrow(run, EDITED)

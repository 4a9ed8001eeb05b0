"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Documents become pieces: only those longer than the capacity are cut, into pieces of
the full capacity, the first of which may be shorter. Packing needs no more than how
many pieces there are of each length, at most one number for each length up to the
capacity: pieces above a third of the capacity are matched greedily, the longest with
the longest that fits, at most two to a sequence; shorter ones go, in descending
length, to the smallest gap that holds them. The plan says which ranks of each length
go to which sequences; each piece finds its place by its rank among equals, which is
counted by task first, so no length gathers in one place.

Defined results: null is an empty text, which is one piece of the end token; repeated
rows are packed as often as they occur; empty tables give empty results; columns of
the input other than id and text are not read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import written

CAPACITY = 1024
END_ID = 2
#: Fixed value: how byte-level BPE splits texts before merging, written without backtracking.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A function from text to ids, as the tokenizer file at path says; a special token's string in a text is that token.

    Plain byte-level BPE runs on the faster of the two libraries, built from the same file.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    plain = spec["model"].get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and not any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    if plain:
        import tiktoken

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: fast.encode(text, allowed_special="all") if any(x in text for x in special) else fast.encode_ordinary(text)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row a piece; (task, nth) counts pieces of equal length. With keep_ids the ids are in an array column."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, task, seen = encoder(path), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4")
        for b in batches:
            rows, kept = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate((np.array(encode(t), "<u4"), end)) if t else end
                at, k = 0, 0
                while at < len(ids):
                    size = min(capacity, (len(ids) - at - 1) % capacity + 1 if at == 0 else capacity)
                    part = ids[at : at + size]
                    rows.append((i, k, at, size, zlib.crc32(part.tobytes()), task, seen[size]))
                    seen[size] += 1
                    if keep_ids:
                        kept.append(part.astype(np.int32))
                    at, k = at + size, k + 1
            cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)] if rows else []
            if rows:
                names = [c.split()[0] for c in PIECES.split(", ")]
                if keep_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    own = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, last rank + 1, first sequence, pieces a sequence, offset of the first), and the number of sequences."""
    left = {size: n for size, n in counts.items() if n > 0}
    rows: list[tuple[int, int, int, int, int, int]] = []
    used_ranks: dict[int, int] = defaultdict(int)
    opened = 0
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number of sequences), sorted

    def place(size: int, first: int, bins: int, each: int, offset: int, total: int) -> None:
        at = used_ranks[size]
        rows.append((size, at, at + total, first, each, offset))
        used_ranks[size] += total

    def room(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            insort(gaps, (gap, first, bins))

    large = sorted(size for size in left if 3 * size > capacity)
    while large:
        size = large[-1]
        k = bisect_left(large, capacity - size + 1) - 1
        if k < 0 or (large[k] == size and left[size] == 1):
            k = k - 1 if k >= 0 and large[k] == size else k
        if k < 0:
            bins = left[size]
            place(size, opened, bins, 1, 0, bins)
            room(capacity - size, opened, bins)
            left[size] = 0
        else:
            mate = large[k]
            bins = left[size] // 2 if mate == size else min(left[size], left[mate])
            if mate == size:
                place(size, opened, bins, 2, 0, 2 * bins)
                left[size] -= 2 * bins
            else:
                place(size, opened, bins, 1, 0, bins)
                place(mate, opened, bins, 1, size, bins)
                left[size] -= bins
                left[mate] -= bins
            room(capacity - size - mate, opened, bins)
        opened += bins
        large = [x for x in large if left[x]]

    for size in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        n = left[size]
        while n:
            k = bisect_left(gaps, (size, -1, -1))
            if k < len(gaps):
                gap, first, bins = gaps.pop(k)
            else:
                gap, first, bins = capacity, opened, -(-n // (capacity // size))
                opened += bins
            each = gap // size
            full = min(bins, n // each)
            if full:
                place(size, first, full, each, capacity - gap, full * each)
                room(gap - each * size, first, full)
                n -= full * each
            if bins > full:
                rest = n if n < each else 0
                if rest:
                    place(size, first + full, 1, rest, capacity - gap, rest)
                    room(gap - rest * size, first + full, 1)
                    n = 0
                room(gap, first + full + bool(rest), bins - full - bool(rest))
    return rows, opened


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces()."""
    spark = cut.sparkSession
    cut = written(cut)
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one for each length
    rows, _ = plan(counts, capacity)
    places = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "p_length long, lo long, hi long, first long, each long, at long")
    before = by_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("task", "length", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    # the plan has a few rows for each length, however many pieces there are
    here = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    nth = F.col("rank") - F.col("lo")
    return ranked.join(F.broadcast(places), here).select(
        *[c for c in cut.columns if c not in ("task", "nth")],
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences' ids in order, from rows that keep their ids; a sequence has at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, **options) -> DataFrame:
    return pack(pieces(docs, **options), options.get("capacity", CAPACITY))

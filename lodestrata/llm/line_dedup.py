"""Line dedup: fuzzy equal lines by MinHash, one line kept of each component.

Lines are compared in a normal form: A to Z in lower case, runs of white space one
blank, none at the ends. A line's set holds its distinct shingles of five code
points; a shorter line is one shingle. Minimum hashes are grouped into bands; lines
that share a band are verified by their exact Jaccard similarity (setjoin), and
union-find joins the verified links. Of each component the line that comes first, by
document id and line number, stays; all others go.

With the default 28 bands of 6 rows out of 84 minimum hashes, each a row of two bands,
9997 in 10,000 random pairs of similarity 0.80 to 0.82 are candidates (measured); equal
lines always meet. Elements are 64-bit hashes of shingles, and equal lines are found by a
64-bit hash.

Defined results: lines without a word stay where they are and are never compared;
null and empty texts are unchanged; rows with one id count as one document (equal
line numbers of such rows are one place); rows without an id are unchanged; of two
equal lines of one document the second goes. Columns other than id and text are
passed through untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _arrays as A
from ._cluster import discard, fresh_name, looked_up, map_arrow, partitions, written
from .setjoin import bucket_links, components

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 28, 6
REMEMBERED = 300_000
#: Bytes of documents taken at a time, shingles sketched at a time, and those of them that fall into bins at a time.
BLOCK, MATRIX, CACHED = 1 << 17, 1 << 20, 1 << 15
#: Shingles signed at a time, lines whose signatures are dealt at a time, rows of a piece of them, and bits of a signature within its bucket.
SIGNED, AT_ONCE, PIECE, LOW = 1 << 20, 32_000, 1 << 13, 40
#: Bytes of files a partition up to which lines need not be counted.
DEALT = 1 << 25
#: Minimum hashes; each is a row of two bands, once with its neighbours and once with those of other groups.
HASHES = BANDS * ROWS // 2
_rng = np.random.default_rng(20240229)
MULTIPLIERS = (_rng.integers(0, 1 << 16, HASHES) | 1).astype(np.uint16)
SHIFTS = _rng.integers(0, 1 << 16, HASHES).astype(np.uint16)[: HASHES // 3]
BAND_TAGS = _rng.integers(0, 1 << 64, BANDS, dtype=np.uint64)
BAND_ROWS = np.array([[(j + t * turn) % (BANDS // 2) * ROWS + t for t in range(ROWS)] for turn in (0, 1) for j in range(BANDS // 2)])
#: Minimum hashes, three a shift, of which no two are of one band: they take the same 16 bits of a shingle's hash.
SHIFTED = [[lane + 4 * (7 * k + (q + 3 * k) % 7) for k in range(3)] for q in range(HASHES // 12) for lane in range(4)]
SHIFT_OF, LANES = np.empty(HASHES, np.uint16), (16 * (np.arange(HASHES) % 4)).astype(np.uint64)
for _c, _three in zip(SHIFTS, SHIFTED, strict=True):
    SHIFT_OF[_three] = _c
#: Multipliers of the rounds in which shingles fall into bins, and an empty bin.
ROUNDS = _rng.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
EMPTY = np.uint32(0xFFFFFFFF)
#: Shingles of a line of which repeats are taken out, if two rounds leave a bin of it empty.
SEVERAL = 512


#: A to Z in lower case, white space but line feeds as blanks.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 11, 12, 13) else c for c in range(256))


class Lines:
    """The lines with words of a block of documents, in normal form."""

    def __init__(self, texts: list[bytes]):
        data = (b"\n".join(texts) + b"\n").translate(NORMAL)
        code = np.frombuffer(data, np.uint8) if data.isascii() else np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        feed = code == 10
        if b"  " in data or b"\n " in data or data[:1] == b" ":  # the first of a run of blanks stays, none after a line feed
            blank = code == 32
            before = np.ones(len(code), bool)
            before[1:] = blank[:-1] | feed[:-1]
            keep = ~(blank & before)
            code, feed = code[keep], feed[keep]
        ends = np.flatnonzero(feed)
        begins = np.concatenate(([0], ends[:-1] + 1))
        n_lines = np.array([t.count(b"\n") + 1 for t in texts])
        owner = np.repeat(np.arange(len(texts)), n_lines)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
        trail = (ends > begins) & (code[np.maximum(ends - 1, 0)] == 32)
        ends = ends - trail
        held = ends > begins
        self.code, self.begins, self.ends = code, begins[held], ends[held]
        self.owner, self.number = owner[held], number[held]

    def hashes(self) -> np.ndarray:
        return A.span_hashes(self.code, self.begins, self.ends) if len(self.begins) else np.empty(0, np.uint64)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of the chosen lines (ascending), line after line, and each line's first."""
        b, e = self.begins[which], self.ends[which]
        size = np.maximum(e - b - SHINGLE + 1, 1)
        first = np.cumsum(size) - size
        begun = np.zeros(len(self.code) + 1, np.int8)
        begun[b], begun[b + size] = 1, -1
        h = np.zeros(len(self.code), np.uint64)
        n = len(self.code) - SHINGLE + 1
        if n > 0:  # a polynomial in the five code points: of two pairs and one
            by = np.uint64(0xD6E8FEB86659FD93)
            code = self.code.astype(np.uint64)
            two = code[:-1] * by
            two += code[1:]
            np.multiply(two[:n], np.uint64(int(by) ** 2 % 2**64), out=h[:n])
            h[:n] += two[2 : n + 2]
            h[:n] *= by
            h[:n] += code[4:]
        short = np.flatnonzero(e - b < SHINGLE)
        if len(short):
            h[b[short]] = A.span_hashes(self.code, b[short], e[short])
        return A.mix64(h[np.cumsum(begun, dtype=np.int8)[:-1].view(bool)]), first


def _distinct(h: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles without the repeats in the lines named, and the lines' sizes."""
    ends, parts, done = np.cumsum(size), [], 0
    size = size.copy()
    for k in which.tolist():
        x = np.unique(h[ends[k] - size[k] : ends[k]])
        parts += [h[done : ends[k] - size[k]], x]
        done, size[k] = ends[k], len(x)
    return np.concatenate([*parts, h[done:]]), size


def _last_minima(h: np.ndarray, size: np.ndarray, line: np.ndarray, bin: np.ndarray) -> np.ndarray:
    """For each of these lines and bins the minimum hash of all the line's shingles."""
    first, out, lo = np.cumsum(size) - size, np.empty(len(line), np.uint32), 0
    ends = np.cumsum(size[line])
    while lo < len(line):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MATRIX // 4, "right")))
        n, k = size[line[lo:hi]], bin[lo:hi]
        begin = np.cumsum(n) - n
        x = h[np.repeat(first[line[lo:hi]] - begin, n) + np.arange(n.sum())]
        x = (x >> np.repeat(LANES[k], n)).astype(np.uint16) ^ np.repeat(SHIFT_OF[k], n)
        out[lo:hi] = np.minimum.reduceat(x * np.repeat(MULTIPLIERS[k], n), begin)
        lo = hi
    return out


def _fall(lows: np.ndarray, h: np.ndarray, size: np.ndarray, line: np.ndarray, k: int) -> None:
    """Round k: the shingles of these lines fall into the lines' bins that are still empty, as many at a time as the CPU's cache takes."""
    ends, flat, lo = np.cumsum(size), lows.reshape(-1), 0
    while lo < len(size):
        begin = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + CACHED, "right")))
        x = h[begin : ends[hi - 1]]
        x = x * ROUNDS[k] if k else x
        at = x >> np.uint64(32)
        at *= np.uint64(HASHES)
        at >>= np.uint64(32)
        at = at.view(np.int64)
        at += np.repeat(line[lo:hi] * HASHES, size[lo:hi])
        if k:
            empty = np.flatnonzero(flat.take(at) == EMPTY)
            at, x = at[empty], x[empty]
        np.minimum.at(flat, at, x.astype(np.uint32))
        lo = hi


def minima(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """HASHES values a line, of which two lines share a part that is their similarity: fast similarity sketching.

    In each of ROUNDS rounds a shingle falls into one bin of a line's, and the smallest of a bin that no round before
    filled is its value; a bin that no round fills takes a minimum hash of all shingles. Depends on the set of shingles only.
    """
    lows = np.full((len(size), HASHES), EMPTY, np.uint32)
    left = np.arange(len(size))
    for k in range(len(ROUNDS)):
        _fall(lows, h, size, left, k)
        open_ = (lows[left] == EMPTY).any(axis=1)
        if not open_.any():
            return lows
        if k:  # after the first round most lines are open
            h, size, left = h[np.repeat(open_, size)], size[open_], left[open_]
        if k == 1:  # long and still open, so of few shingles many times over
            h, size = _distinct(h, size, np.flatnonzero(size > SEVERAL))
    line, bin = np.nonzero(lows[left] == EMPTY)
    lows[left[line], bin] = _last_minima(h, size, line, bin)
    return lows


def band_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row a line of BANDS signatures, from its shingles' hashes."""
    ends = np.append(first[1:], len(h))
    out = np.zeros((len(first), BANDS), np.uint64)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, min(int(np.searchsorted(ends, first[lo] + MATRIX, "right")), lo + MATRIX // HASHES))
        lows = np.ascontiguousarray(minima(h[first[lo] : ends[hi - 1]], ends[lo:hi] - first[lo:hi]).T)
        for k in range(0, hi - lo, 1024):
            bands = np.zeros((BANDS, min(1024, hi - lo - k)), np.uint64)
            for t in range(ROWS):
                bands *= np.uint64(0xD6E8FEB86659FD93)
                bands += lows[BAND_ROWS[:, t], k : k + 1024]
            out[lo + k : lo + k + bands.shape[1]] = bands.T
        lo = hi
    return A.mix64(out + BAND_TAGS)


def _blocks(texts: list[bytes]):
    """Runs of documents of about a block's size."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > BLOCK:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def _order(s: np.ndarray) -> np.ndarray:
    """The rows in the order of s, as argsort: rows' numbers take the lowest bits and are sorted with the rest, which is faster."""
    bits = max(1, len(s).bit_length())
    key = s >> np.uint64(bits)
    key <<= np.uint64(bits)
    key |= np.arange(len(s), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << bits) - 1)).view(np.int64)
    x = s[order]
    return np.argsort(s) if (x[1:] < x[:-1]).any() else order  # some differ in the lowest bits only


def spread(sigs: np.ndarray, nodes: np.ndarray, buckets: int):
    """Signatures of lines -> pieces (bucket, bytes) of at most PIECE rows, for gathered(), by ranges of signatures.

    A signature that several of these lines have goes to its bucket with one of them only, and with all of them
    to a bucket below 0, whichever takes it: no bucket has a signature more often than there are calls.
    """
    order = _order(sigs)
    s, node = sigs[order], nodes[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    alone = new & np.append(new[1:], True)
    bucket = ((s >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    name = (bucket << np.uint64(LOW)) | (s & np.uint64((1 << LOW) - 1))
    both, ids = name[~alone], node[~alone]
    for k, lo in enumerate(range(0, len(both), PIECE)):
        yield -1 - (int(both[lo]) + k) % buckets, both[lo : lo + PIECE].tobytes() + ids[lo : lo + PIECE].tobytes()
    bucket, name, node = bucket[new].astype(np.int64), name[new], node[new]
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        for lo in range(int(ends[k]), int(ends[k + 1]), PIECE):
            hi = min(lo + PIECE, int(ends[k + 1]))
            x = name[lo:hi]
            yield k, x.astype(np.uint32).tobytes() + (x >> np.uint64(32)).astype(np.uint8).tobytes() + node[lo:hi].tobytes()


def gathered(bucket: int, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces of a bucket -> signatures (named by bucket and low bits) that two lines at least have, and their lines; of a bucket below 0 all."""
    if bucket < 0:
        n = [len(p) // 16 for p in pieces]
        return np.concatenate([np.frombuffer(p, np.uint64, k) for p, k in zip(pieces, n, strict=True)]), np.concatenate([np.frombuffer(p, np.uint64, k, 8 * k) for p, k in zip(pieces, n, strict=True)])
    n = [len(p) // 13 for p in pieces]
    s = np.concatenate([np.frombuffer(p, np.uint32, k) | np.frombuffer(p, np.uint8, k, 4 * k).astype(np.uint64) << np.uint64(32) for p, k in zip(pieces, n, strict=True)])
    node = np.concatenate([np.frombuffer(p[5 * k :], np.uint64) for p, k in zip(pieces, n, strict=True)])
    x = np.sort(s)
    often = np.zeros(1 << 20, bool)  # by the lowest bits: most signatures that are alone go here
    often[x[1:][x[1:] == x[:-1]] & np.uint64(0xFFFFF)] = True
    at = np.flatnonzero(often[s & np.uint64(0xFFFFF)])
    at = at[np.lexsort((node[at], s[at]))]
    s, node = s[at], node[at]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (node[1:] != node[:-1])
    s, node = s[new], node[new]
    same = s[1:] == s[:-1]
    met = np.append(False, same) | np.append(same, False) if len(s) else np.empty(0, bool)
    return s[met] | np.uint64(bucket << LOW), node[met]


def spread_places(node: np.ndarray, id: np.ndarray, line: np.ndarray, ranges: int):
    """Places of lines -> pieces (range, bytes) for first_places(), by ranges of nodes, each node's first; then, in range -1, the other places."""
    order = np.lexsort((line, id, node))
    node, id, line = node[order], id[order], line[order]
    new = np.ones(len(node), bool)
    new[1:] = node[1:] != node[:-1]
    other = ~new
    other[1:] &= (id[1:] != id[:-1]) | (line[1:] != line[:-1])  # rows that share an id are one document
    node, own, at = node[new], id[new], line[new]
    ends = np.searchsorted(((node >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        for lo in range(int(ends[k]), int(ends[k + 1]), PIECE):
            x = slice(lo, min(lo + PIECE, int(ends[k + 1])))
            yield k, node[x].tobytes() + own[x].tobytes() + at[x].tobytes()
    own, at = id[other], line[other]
    for lo in range(0, len(own), PIECE):
        x = slice(lo, lo + PIECE)
        yield -1, bytes(8 * len(own[x])) + own[x].tobytes() + at[x].tobytes()


def places(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, ids and line numbers of pieces of spread_places()."""
    n = [len(p) // 20 for p in pieces]
    of = lambda kind, by: np.concatenate([np.frombuffer(p, kind, k, by * k) for p, k in zip(pieces, n, strict=True)])
    return of(np.uint64, 0), of(np.int64, 8), of(np.int32, 16)


def first_places(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces of a range -> nodes, ids, line numbers and whether it is the node's first place; each place once."""
    node, id, line = places(pieces)
    order = np.lexsort((line, id, node))
    node, id, line = node[order], id[order], line[order]
    first, once = np.ones(len(node), bool), np.ones(len(node), bool)
    first[1:] = node[1:] != node[:-1]
    once[1:] = first[1:] | (id[1:] != id[:-1]) | (line[1:] != line[:-1])
    return node[once], id[once], line[once], first[once]


#: Kinds of rows of _found().
MET, FIRST, AGAIN = range(3)


def _found(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(id, text) -> kind, node, at, line: in one pass over the texts what lines have in common and where they are.

    MET: the signatures (at) that two lines (node) at least have, some rows twice; a task signs equal lines once.
    FIRST: each line's first place, by document (at) and line number. AGAIN: the other places of equal lines.
    """
    ranges = max(1, buckets // 8)

    def sign(batches):
        import pyarrow as pa

        seen: set[int] = set()
        waiting, nodes, sigs, n = [], [], [], 0  # the waiting lines' shingles are signed together
        held, n_held = [], 0

        def signed_now():
            first = np.cumsum([0] + [len(h) for h, _ in waiting])
            sigs.append(band_hashes(np.concatenate([h for h, _ in waiting]), np.concatenate([f + at for (_, f), at in zip(waiting, first, strict=False)])))
            waiting.clear()

        def packed():
            if waiting:
                signed_now()
            pieces = list(spread(np.concatenate(sigs).ravel(), np.repeat(np.concatenate(nodes), BANDS), buckets)) if n else []
            # ranges of places come after the buckets, places that nothing else is asked of after those
            pieces += [(buckets + (k if k >= 0 else ranges + j % buckets), x) for j, (k, x) in enumerate(spread_places(*[np.concatenate(x) for x in zip(*held, strict=True)], ranges))]
            for lo in range(0, len(pieces), 256):
                part = pieces[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int32()), pa.array([x for _, x in part], pa.binary())], names=["bucket", "data"])

        for b in batches:
            texts = A.as_bytes(b.column(1))
            order = sorted(range(len(texts)), key=lambda k: not texts[k].isascii())  # blocks of ASCII need no decoding
            ids, texts = b.column(0).to_numpy()[order], [texts[k] for k in order]
            for lo, hi in _blocks(texts):
                lines = Lines(texts[lo:hi])
                if not len(lines.begins):
                    continue
                node = lines.hashes()
                held.append((node, ids[lo:hi][lines.owner], lines.number.astype(np.int32)))
                n_held += len(node)
                _, first = np.unique(node, return_index=True)
                new = np.array([k for k, x in zip(first.tolist(), node[first].tolist(), strict=True) if x not in seen], np.int64)
                new.sort()
                if len(new):
                    if len(seen) + len(new) > REMEMBERED:
                        seen.clear()
                    seen.update(node[new].tolist())
                    nodes.append(node[new])
                    waiting.append(lines.shingles(new))
                    n += len(new)
                    if sum(len(h) for h, _ in waiting) >= SIGNED:
                        signed_now()
                if n >= AT_ONCE or n_held >= 4 * AT_ONCE:
                    yield from packed()
                    nodes, sigs, n, held, n_held = [], [], 0, [], 0
        if n_held:
            yield from packed()

    def meet(batches):
        import pyarrow as pa

        def rows(bucket, pieces):
            if bucket < buckets:
                at, node = gathered(bucket, pieces)
                line, kind = np.zeros(len(node), np.int32), np.full(len(node), MET, np.int8)
            elif bucket < buckets + ranges:
                node, at, line, first = first_places(pieces)
                kind = np.where(first, FIRST, AGAIN).astype(np.int8)
            else:
                node, at, line = places(pieces)
                kind = np.full(len(node), AGAIN, np.int8)
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(node.view(np.int64)), pa.array(at.view(np.int64)), pa.array(line)], names=["kind", "node", "at", "line"])

        now, pieces = None, []
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now or not 0 <= k < buckets + ranges:
                    if pieces:
                        yield rows(now, pieces)
                    now, pieces = k, []
                pieces.append(x)
        if pieces:
            yield rows(now, pieces)

    signed = docs.where("id is not null and text is not null").select("id", "text").mapInArrow(sign, "bucket int, data binary")
    return signed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "kind tinyint, node long, at long, line int")


def _texts_of(docs: DataFrame, lines: DataFrame):
    """The texts of the asked lines, taken from the first document that holds each; lines(node, id, line) has each line's first place."""

    def fetch(ids: DataFrame) -> DataFrame:
        place = looked_up(lines, ids.withColumnRenamed("id", "node"), "node", "left_semi")
        asked = place.groupBy("id").agg(F.collect_list(F.struct("line", "node")).alias("asked"))  # at most a document's own lines

        def run(batches):
            import pyarrow as pa

            for b in batches:
                nodes, found = [], []
                for t, asked in zip(A.as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                    parts = t.split(b"\n")
                    for x in asked:
                        if x["line"] < len(parts):
                            nodes.append(x["node"])
                            found.append(parts[x["line"]])
                for lo, hi in _blocks(found):
                    block = Lines(found[lo:hi])
                    node = np.array(nodes[lo:hi], np.int64)[block.owner]
                    ok = np.flatnonzero(block.hashes().view(np.int64) == node)  # rows that share an id may differ
                    yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array([found[lo + k] for k in block.owner[ok]], pa.binary())], names=["id", "items"])

        return looked_up(docs.where("id is not null"), asked, "id").select("text", "asked").mapInArrow(run, "id long, items binary").dropDuplicates(["id"])

    return fetch


def elements(column) -> list[np.ndarray]:
    """Distinct shingles of each line of an Arrow column of single lines with a word."""
    texts, out = [b or b"" for b in column.to_pylist()], []
    for lo, hi in _blocks(texts):
        block = Lines(texts[lo:hi])
        h, first = block.shingles(np.arange(len(block.begins)))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(h)], strict=True):
            h[lo:hi].sort()
        new = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=new[1:])
        new[first] = True
        first = (np.cumsum(new) - 1)[first]
        h = h[new]
        out += [h[lo:hi] for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(h)], strict=True)]
    return out


def buckets(docs: DataFrame) -> int:
    """As many that they spread evenly over the partitions and that each has about a million rows at most; lines are counted only where the partitions are few for the input."""
    n = partitions(docs.sparkSession)
    if int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= n * DEALT:
        return 16 * n
    feeds = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    return max(16 * n, (feeds or 0) * BANDS >> 20)


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, line) of the lines that go; lines are numbered from 0."""
    own = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    found = written(_found(own, buckets(own)))
    common = found.where(F.col("kind") == MET).select(F.col("at").alias("sig"), F.col("node").alias("id"))
    lines = found.where(F.col("kind") == FIRST).select("node", F.col("at").alias("id"), "line")
    links = bucket_links(common, _texts_of(own, lines), elements, percent)
    comp = components(links)
    # all places of a line but its first go; of a component's first places one stays
    members = written(comp.union(comp.select(F.col("component").alias("id"), "component").distinct()).withColumnRenamed("id", "node"))
    placed = written(looked_up(lines, members, "node").select("component", "id", "line"))
    first = placed.groupBy("component").agg(F.min(F.struct("id", "line")).alias("first"))
    gone = looked_up(placed, first, "component").where("struct(id, line) <> first").select("id", "line")
    return gone.union(found.where(F.col("kind") == AGAIN).select(F.col("at").alias("id"), "line"))


def without_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, *, counts: bool = False) -> DataFrame:
    """The documents with the lines that go taken out; with counts, also n_lines (with words) and n_dropped, else documents left without any line go too."""
    gone = repeated_lines(docs, id, text, percent)
    key, drop = fresh_name(docs, "__id"), fresh_name(docs, "__drop")
    per_doc = written(gone.groupBy(F.col("id").alias(key)).agg(F.collect_set("line").alias(drop)))
    rows = looked_up(docs, per_doc, F.col(f"`{id}`") == F.col(key), "left").select(*[F.col(f"`{c}`") for c in docs.columns], drop)
    emptied = fresh_name(docs, "__emptied")
    extra = [T.StructField(emptied, T.BooleanType())] + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped") if counts]
    schema = T.StructType([*docs.schema.fields, *extra])
    names = [f.name for f in schema.fields]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = b.schema.get_field_index(text)
            texts, drops = b.column(at).to_pylist(), b.column(b.schema.get_field_index(drop)).to_pylist()
            out, empty, n, d = [], [], [], []
            for t, x in zip(texts, drops, strict=True):
                x = set(x or ())
                parts = t.split("\n") if t is not None and (x or counts) else []
                kept = [p for k, p in enumerate(parts) if k not in x] if x else parts
                out.append("\n".join(kept) if x and t is not None else t)
                empty.append(bool(x) and not any(_has_word(p) for p in kept))
                if counts:
                    n.append(sum(_has_word(p) for p in parts))
                    d.append(len(x))
            cols = [pa.array(out, b.schema.field(at).type) if i == at else b.column(i) for i, c in enumerate(b.schema.names) if c != drop]
            cols += [pa.array(empty, pa.bool_())] + ([pa.array(n, pa.int64()), pa.array(d, pa.int64())] if counts else [])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    done = map_arrow(rows, run, schema)
    return done.drop(emptied) if counts else done.where(~F.col(emptied)).drop(emptied)


def _has_word(line: str) -> bool:
    return bool(line.strip("\x20\t\n\v\f\r"))

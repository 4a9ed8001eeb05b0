"""Vectorised text primitives shared by the operators of this subpackage.

Texts are handled as UTF-8 bytes. Documents are joined into blocks of about
``BLOCK`` bytes so that the arrays stay in the CPU's cache; one longer document
forms a block of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    shifted = x >> np.uint64(31)
    x = x ^ shifted
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= np.right_shift(x, np.uint64(27), out=shifted)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= np.right_shift(x, np.uint64(33), out=shifted)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, for n positions."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for b in (_BASE, inverse):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def blocks(texts: list[bytes], block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, starts): documents joined by line feeds; starts has one more entry than documents."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > block:
            yield _block(texts, first, i)
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield _block(texts, first, len(texts))


def _block(texts: list[bytes], lo: int, hi: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"\n".join(texts[lo:hi]) + b"\n", np.uint8)
    starts = np.zeros(hi - lo + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts[lo:hi]], out=starts[1:])
    return lo, hi, buf, starts


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without space, tab, \\n, \\v, \\f and \\r; buf must end in one of them."""
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    n = len(buf)
    up, down = _power_tables(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + mix64((ends - starts).astype(np.uint64)))


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``width`` items of one owner, and the index of its first item."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += hashes[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix64(h[at]), at


def packed(buf: np.ndarray, width: int) -> np.ndarray:
    """Each run of ``width`` (1 to 8) bytes as one integer, exactly."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = buf[:n].astype(np.uint64)
    for k in range(1, width):
        x |= buf[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return x


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8, null as empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def code_points(buf: np.ndarray) -> np.ndarray:
    """Marks the bytes that begin a code point."""
    return (buf & np.uint8(0xC0)) != np.uint8(0x80)

"""Vectorised word and n-gram hashing over Arrow string columns (bytes in, NumPy arrays out)."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def rand64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


_BYTE = rand64(11, 256)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 2**64)
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)], dtype=np.uint64) for b in (_BASE, inverse))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and n + 1 offsets. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _edges(kind: np.ndarray, at: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal kind within a row; only runs whose bytes are solid."""
    n = len(kind)
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[at] = True
    where = np.flatnonzero(cut)
    start, end = where[:-1], where[1:]
    keep = solid[start]
    return start[keep], end[keep]


def runs(raw: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, for each row, the first index of its runs. kinds: 256 byte classes, 0 ends a run and is left out."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kind = kinds[raw]
    start, end = _edges(kind, at, kind != 0)
    return start, end, np.searchsorted(start, at)


def hash_runs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each run of bytes, whole runs, whatever their place. Works by segments of about 1 MB."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _SEGMENT, "right")))
        n = int(end[j - 1] - base)
        pw, inv = _powers(_SEGMENT) if n <= _SEGMENT else _powers(n)
        c = np.empty(n + 1, np.uint64)
        c[0] = 0
        np.cumsum(_BYTE[raw[base : base + n]] * pw[:n], out=c[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (c[e] - c[s]) * inv[s]
        i = j
    return mix(out)


WORDS = (~SPACE).astype(np.uint8)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than ASCII white space), and n + 1 offsets into them."""
    start, end, first = runs(raw, at, WORDS)
    return hash_runs(raw, start, end), first


_STEP = rand64(13, 64)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of width words; of all words together where there are fewer; none of none."""
    n = len(h)
    if not n:
        return h
    k = min(width, n)
    total = np.full(n - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        total += h[j : n - k + 1 + j] * (_STEP[j] | np.uint64(1))
    return mix(total)

"""Vectorised scanning of Arrow text columns: the UTF-8 bytes of many documents at once, without a Python string each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        m = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _BASE_INV)):
                x = np.full(m + 1, base, np.uint64)
                x[0] = 1
                _POWERS[key] = np.multiply.accumulate(x)
        _POWERS["n"] = m
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


def blocks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) for runs of rows of about max_bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of non-space bytes; runs end where a document ends."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[buf]
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = off[:-1]
    before[inner[inner < len(buf)]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, the same wherever the span stands."""
    up, down = _powers(len(buf))
    with np.errstate(over="ignore"):
        s = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=s[1:])
        return mix((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of k words; a row of one to k-1 words has its whole sequence as one."""
    count = np.bincount(row, minlength=rows)
    with np.errstate(over="ignore"):
        weight = [np.uint64(pow(_BASE, 3 * j + 1, 1 << 64)) for j in range(k)]
        full, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(h) >= k:
            same = row[: len(row) - k + 1] == row[k - 1 :]
            acc = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                acc += h[j : len(h) - k + 1 + j] * weight[j]
            full, at = mix(acc[same] + np.uint64(k)), row[: len(row) - k + 1][same]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            first = np.searchsorted(row, short)
            acc = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                here = count[short] > j
                acc[here] += h[first[here] + j] * weight[j]
            full = np.concatenate([full, mix(acc + count[short].astype(np.uint64))])
            at = np.concatenate([at, short])
    return full, at

"""Numpy helpers over the flat UTF-8 buffer of an Arrow string column.

A batch of texts is one ``uint8`` array plus row bounds, so words, word hashes and
word windows of thousands of documents are found with a few array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of words under ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~SPACE
#: bytes of words under ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, a-z, everything beyond ASCII)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_seeds = np.random.default_rng(20240607)
BYTE_KEYS = _seeds.integers(0, 2**64, 256, dtype=np.uint64)
#: odd factors for the places of a window
PLACES = _seeds.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row bounds (length rows + 1); null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, limit: int = 1 << 19, most: int = 1 << 30):
    """Row ranges (low, high) of at most `limit` bytes and `most` rows, or of one longer row."""
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        high = min(high, rows, low + most)
        yield low, high
        low = high


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and each row's bounds among them. Words never cross rows."""
    inside = kind[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edges = bounds[:-1][bounds[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[edges] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that are sorted by start, in blocks of bounded memory."""
    return many_span_hashes(data, starts, [ends])[0]


def many_span_hashes(data: np.ndarray, starts: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """The same for several ends of each start, such as prefixes of words; the first holds the longest spans."""
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + _BLOCK // 2)))
        low, high = int(starts[a]), int(ends[0][a:b].max())
        up, down = powers(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_KEYS[data[low:high]] * up[: high - low], out=total[1:])
        s = starts[a:b] - low
        for found, stop in zip(out, ends):
            e = stop[a:b] - low
            found[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * PLACES[63])
        a = b
    return out


def window_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive items that lie in one row, and the index of each one's first item."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:n] * PLACES[0]
    for j in range(1, k):
        total += hashes[j : j + n] * PLACES[j]
    inside = np.ones(n + 1, bool)
    for back in range(1, k):  # windows that reach over the end of their row
        at = bounds[1:] - back
        at = at[(at >= 0) & (at < n) & (at >= bounds[:-1])]
        inside[at] = False
    first = np.flatnonzero(inside[:n])
    return mix(total[first]), first


def rows_of(first: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The row that each item index belongs to."""
    return np.searchsorted(bounds, first, "right") - 1

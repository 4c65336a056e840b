"""Word shingles as 64-bit hashes, by numpy over a text's bytes.

Words are runs without ASCII white space, A-Z lower-cased.  A word's hash is a
polynomial over its bytes modulo 2^64 (read off prefix sums and made free of
its place), mixed with its length; words over ``LONG`` bytes are hashed by
xxh3.  A shingle's hash folds the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 20
LONG = 1 << 16
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_power = _back = np.ones(0, U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _back
    if len(_power) < n:
        size = 1 << max(14, (n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        _power = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, BASE, U)]))
        _back = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, inverse, U)]))
    return _power[:n], _back[:n]


def _mix(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> U(31))
    a = a * U(0xD6E8FEB86659FD93)
    return a ^ (a >> U(29))


def word_hashes(text: np.ndarray) -> np.ndarray:
    """One hash per word of the bytes ``text`` (uint8)."""
    inner = np.empty(len(text) + 2, bool)
    inner[0] = inner[-1] = False
    np.take(_WORD, text, out=inner[1:-1])
    edge = np.flatnonzero(inner[1:] != inner[:-1])
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        low = int(start[at])
        stop = int(np.searchsorted(start, low + PIECE))
        s, e = start[at:stop] - low, end[at:stop] - low
        short = e - s <= LONG
        span = int(e[short].max()) if short.any() else 0
        power, back = _tables(span + 1)
        sums = np.zeros(span + 1, U)
        np.cumsum((_LOWER[text[low:low + span]].astype(U) + U(1)) * power[:span], out=sums[1:])
        h = np.empty(len(s), U)
        h[short] = (sums[e[short]] - sums[s[short]]) * back[s[short]]
        for k in np.flatnonzero(~short):
            h[k] = xxhash.xxh3_64_intdigest(_LOWER[text[low + s[k]:low + e[k]]].tobytes())
        out[at:stop] = _mix(h ^ ((e - s).astype(U) * U(0xA24BAED4963EE407)))
        at = stop
    return out


def shingle_set(text: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` are one
    shingle; no words give none."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(width, len(h))
    n = len(h) - k + 1
    a = np.full(n, k, U)
    for i in range(k):
        a = _mix((a ^ h[i:i + n]) * U(BASE))
    return np.unique(a)


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text, without a copy; null is empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield body[:0] if nulls[k] else body[at[k]:at[k + 1]]


def class_id(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of the set."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))
    return value - (1 << 64) if value >= 1 << 63 else value

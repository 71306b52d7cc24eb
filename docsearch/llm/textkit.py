"""Vectorised text kernels over Arrow string columns.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; these bytes never
occur inside a UTF-8 multi-byte sequence, so words can be cut on bytes without
decoding.  Nulls count as empty texts.  All functions take whole texts; they work on
pieces of about ``PIECE`` bytes at document borders, so that memory does not
grow with the batch (a single text longer than that is one piece).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_MASK = (1 << 64) - 1
#: Any odd multiplier will do; its inverse modulo 2**64 exists.
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        for i, p in enumerate((_P, _PINV)):
            a = np.full(n, p, np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix); another salt gives another hash."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & _MASK)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i has bytes[offsets[i]:offsets[i + 1]]; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(offsets: np.ndarray, most: int = PIECE):
    """Ranges of rows of at most so many bytes together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def spans(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows i to j: (bytes of the piece, starts, ends, row of each word less i)."""
    lo, hi = int(offsets[i]), int(offsets[j])
    b = raw[lo:hi]
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[i + 1 : j] - lo
    if len(cuts):  # a word never crosses a border of rows
        cuts = cuts[(cuts > 0) & (cuts < len(b))]
        cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1] == 1])
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    rows = np.searchsorted(offsets[i : j + 1] - lo, starts, "right") - 1
    return b, starts, ends, rows


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased if asked."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _grow(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[b] if lower else b] * power[: len(b)], out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes by row: (hashes sorted within rows, n_rows + 1 offsets).

    A row of 1 to k - 1 words has its whole sequence as one shingle, a row without words none.
    """
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    n = len(words)
    mult = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k - 1 - j, 1 << 64)) for j in range(k)]
    whole = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    h = np.full(len(whole), k, np.uint64)
    for j in range(k):
        h += words[whole + j] * mult[j]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        hs = count[short].astype(np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            hs[has] += words[first[short[has]] + j] * mult[j]
        h, at = np.concatenate([h, hs]), np.concatenate([rows[whole], short])
    else:
        at = rows[whole]
    h = mix(h)
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        h, at = h[new], at[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n_rows))])


def shingle_sets(column: pa.Array, k: int = 5):
    """Yields (i, j, hashes, offsets) for pieces of the column, words lower-cased A-Z."""
    raw, offsets = buffers(column)
    for i, j in pieces(offsets):
        b, s, e, rows = spans(raw, offsets, i, j)
        h, off = shingles(word_hashes(b, s, e), rows, j - i, k)
        yield i, j, h, off

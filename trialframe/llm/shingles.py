"""Hashed words and word shingles straight from Arrow text buffers, in numpy.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased; or,
with ``plain``, runs of ASCII letters and digits and of bytes beyond ASCII,
with A-Z and the capitals of Latin-1 lower-cased.  A shingle is ``k`` words in
a row; a text of fewer words is one shingle.  Words and shingles are 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
PIECE_BYTES = 1 << 19        # bytes of text hashed in one go (more for a longer single text)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


@lru_cache(maxsize=2)
def byte_tables(plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Value of each lower-cased byte, and whether it separates words."""
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += U(32)
    space = np.zeros(256, bool)
    if plain:
        space[[i for i in range(128) if not chr(i).isalnum()]] = True
    else:
        space[[32, *range(9, 14)]] = True
    return mix((lower + U(1)) * U(BASE)), space


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64 for i < size."""
    def run(b):
        x = np.full(size, U(b))
        x[0] = U(1)
        return np.multiply.accumulate(x)
    return run(BASE), run(pow(BASE, -1, 2 ** 64))


def words(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text) of texts laid end to end in ``data``."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U), np.zeros(n, np.int64)
    value, space = byte_tables(plain)
    if plain:                               # capitals of Latin-1 are C3 80 to C3 9E in UTF-8, but for C3 97
        data = data.copy()
        high = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        data[high] += 0x20
    ink = ~space[data]
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(ink & ~before)
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(ink & ~after) + 1
    size = max(PIECE_BYTES, 1 << int(len(data)).bit_length())
    power, inverse = powers(size)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum(value[data] * power[:len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U) * U(BASE))
    return h, np.diff(np.searchsorted(start, offsets))


def shingle_rows(w: np.ndarray, count: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts laid end to end, shingles per text), repeats included."""
    rows = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.empty(int(rows.sum()), U)
    begin = np.cumsum(count) - count
    if len(w) >= k:
        s = w[:len(w) - k + 1].copy()
        for i in range(1, k):
            s = s * U(BASE) + w[i:len(w) - k + 1 + i]
        whole = np.flatnonzero(count >= k)
        inner = np.zeros(len(w) + 1, np.int64)              # +1 where a text's shingles begin, -1 after them
        np.add.at(inner, begin[whole], 1)
        np.add.at(inner, begin[whole] + rows[whole], -1)
        out[np.repeat(count >= k, rows)] = mix(s[np.flatnonzero(np.cumsum(inner)[:len(s)])])
    at = np.cumsum(rows) - rows
    for i in np.flatnonzero((count < k) & (count > 0)):
        x = np.array([count[i]], U)
        for v in w[begin[i]:begin[i] + count[i]]:
            x = x * U(BASE) + v
        out[at[i]] = mix(x + U(count[i]))[0]
    return out, rows


def shingle_sets(w: np.ndarray, count: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts laid end to end, set sizes)."""
    s, rows = shingle_rows(w, count, k)
    cut = np.concatenate([[0], np.cumsum(rows)])
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if hi - lo > 1:
            s[lo:hi].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[cut[:-1][rows > 0]] = True
    size = np.diff(np.concatenate([[0], np.cumsum(new)])[cut])
    return s[new], size


def text_pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of a string column in bounded pieces; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + PIECE_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def column_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, sorted distinct hashes laid end to end, set sizes) of a string column in pieces."""
    for lo, hi, data, offsets in text_pieces(column):
        yield lo, hi, *shingle_sets(*words(data, offsets), k)

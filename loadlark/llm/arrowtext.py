"""Words and hashes of an Arrow string column as numpy arrays, without a Python string per word.

Used inside tasks; Spark deals out the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words split at white space; of runs of ASCII letters, digits and all other scripts.
NOT_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))
SLICE = 1 << 20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE) + 1
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(size, b, U)])) for b in (_BASE, _INVERSE))
    return _powers


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``size`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it. No word spans rows."""
    m = inside[data]
    n = len(m)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = m.copy(), m.copy()
    starts[1:] &= ~m[:-1] | edge[1:n]
    ends[:-1] &= ~m[1:] | edge[1:n]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from prefix sums of a polynomial."""
    if not len(s):
        return np.zeros(0, U)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s])


@cache
def _cases() -> np.ndarray:
    """For each character of the basic plane the one that stands for it whatever its case, 0 for what is neither letter nor digit.

    The case-folded form if it is one character, else the lower-case one; the upper-case
    one where that is shorter in UTF-8, so that folding never makes a text longer. A
    lower case of two characters (a dotted I) counts as the letter among them.
    """
    size = lambda c: len(c.encode())
    out = np.zeros(0x10000, np.uint32)
    for cp in (*range(0x80), *range(0x80, 0xD800), *range(0xE000, 0x10000)):
        c = chr(cp)
        if c.isalnum():
            forms = ("".join(x for x in f if x.isalnum()) for f in (c.casefold(), c.lower()))
            out[cp] = next((ord(f) for f in forms if len(f) == 1 and size(f) <= size(c)), cp)
    for cp in range(0x80, 0x800):  # a longer lower case goes back to its capital
        low = chr(cp).lower()
        if chr(cp).isalnum() and len(low) == 1 and size(low) > size(chr(cp)):
            out[ord(low)] = cp
    return out


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of valid UTF-8 without their case, and the place of each kept byte.

    The last byte of a character that became shorter has the place of its old last byte.
    """
    chars, keep, place = LOWER[data], ALNUM[data], None
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.uint32)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        cp = b & (0xFF >> (size + 1)).astype(np.uint32)
        for k in (1, 2, 3):
            more = size > k
            cp[more] = cp[more] << 6 | (data[lead[more] + k] & 0x3F)
        new = np.zeros(len(cp), np.uint32)
        plain = cp < 0x10000
        new[plain] = _cases()[cp[plain]]
        if not plain.all():
            high, where = np.unique(cp[~plain], return_inverse=True)
            low = [x.lower() if (x := chr(c)).isalnum() else "\0" for c in high.tolist()]
            new[~plain] = np.array([ord(x) if len(x) == 1 else c for x, c in zip(low, high.tolist(), strict=True)], np.uint32)[where.ravel()]
        length = np.where(new == 0, 0, 1 + (new >= 0x80).astype(np.int64) + (new >= 0x800) + (new >= 0x10000))
        for k in range(4):  # byte k of the new form, dropped where that has fewer
            old = size > k
            keep[lead[old] + k] = (length > k)[old]
            put = length > k
            bits = new[put] >> (6 * (length[put] - 1 - k)).astype(np.uint32)
            first = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[length[put]]
            chars[lead[put] + k] = (first | bits if k == 0 else 0x80 | (bits & 0x3F)).astype(np.uint8)
        short = (length > 0) & (length < size)
        if short.any():
            place = np.arange(len(data))
            place[lead[short] + length[short] - 1] = (lead + size - 1)[short]
    at = np.flatnonzero(keep)
    return chars[at], at if place is None else place[at]

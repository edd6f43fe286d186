"""Vectorised words of whole texts: runs of bytes other than U+0020 and U+0009 to U+000D.

A 64-bit hash of every word comes from prefix sums over the bytes: with odd B,
sum(T[byte] * B**i) over a word's bytes, times B**-start, does not depend on the
word's place, so a batch of texts is hashed with a few numpy passes and no word
is ever built as an object.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; longer texts are taken whole, alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are in a word: all but white space.
DENSE = ~_SPACE
#: Letters, digits and whatever is not ASCII.
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _byte_codes(lower: bool) -> np.ndarray:
    code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    if lower:
        code[65:91] = code[97:123]
    return code


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i <= n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        up, down = (np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most ``limit`` bytes, or of one row."""
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


class Words:
    """Words of rows [first, last) of a column: byte bounds, hashes and each row's range of words."""

    __slots__ = ("data", "start", "end", "hash", "first")

    def __init__(self, off: np.ndarray, data: np.ndarray, first: int, last: int, lower: bool = False, inside: np.ndarray = DENSE):
        lo, hi = int(off[first]), int(off[last])
        self.data = data[lo:hi]
        n = hi - lo
        edge = np.zeros(n + 1, bool)  # a text ends where the next begins, space or none
        edge[off[first : last + 1] - lo] = True
        word = inside[self.data]
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1 : n + 1])) + 1
        self.first = np.searchsorted(self.start, off[first : last + 1] - lo)
        up, down = _power_tables(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_codes(lower)[self.data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])


def windows(word_hash: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` words, at the run's first word; ends of texts are the caller's."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(mix(np.array([salt + 1], np.uint64))[0]))
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + word_hash[k : k + n]
    return mix(out)

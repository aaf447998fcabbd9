"""Vectorised text primitives over Arrow string buffers.

Everything here works on the UTF-8 bytes of many rows at once with numpy, so
that a pass over a corpus costs nanoseconds a byte and no Python object per
word.  Hashes of words are polynomial in 64-bit arithmetic and then mixed;
they don't depend on the row, the batch or the partition a word is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits look independent."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_table(normalise: bool) -> np.ndarray:
    """What each byte becomes; 0 separates words.

    normalise: ASCII letters are lower-cased and ASCII punctuation separates
    too.  Otherwise only the six white-space bytes separate."""
    t = np.arange(256, dtype=np.uint8)
    t[[32, 9, 10, 11, 12, 13]] = 0
    if normalise:
        t[65:91] += 32
        for b in range(1, 128):
            if not chr(b).isalnum() and b != 10:
                t[b] = 0
    return t


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def runs(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about `most` bytes; a longer row is a run of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of a run of rows: byte spans, the row of each, and hashes.

    starts, ends: byte positions in `data`; row: index of the row within the
    run; first: for each row, the index of its first word (one more entry at
    the end)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray, breaks: np.ndarray | None = None):
        """off: row offsets into data, off[0] == 0.  breaks: further byte positions where a word can't continue."""
        self.data, self.off = table[data], off
        n = len(data)
        full = self.data != 0
        begin, end = full.copy(), full.copy()
        begin[1:] &= ~full[:-1]
        end[:-1] &= ~full[1:]
        edge = off[(off > 0) & (off < n)]
        begin[edge] |= full[edge]
        end[edge - 1] |= full[edge - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))


class Hasher:
    """Hashes of byte spans by prefix sums of a polynomial; powers are kept for as long a buffer as was met."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 20)
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inverse)]))

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts])


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= STEP
        out += h[j : j + n]
    return mix(out)


def within(row: np.ndarray, k: int) -> np.ndarray:
    """Which shingles of k words lie in one row."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1 :] if n > 0 else np.zeros(0, bool)


def bits(h: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash as a row of 0 and 1."""
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def pack(ones: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans as unsigned 64-bit values; inverse of bits()."""
    return np.packbits(ones.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


SLAB = 1 << 15


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each group of hashes first[i]:first[i+1]: a bit is 1 if set in over half of them; an empty group gives 0.

    Works through at most SLAB hashes at a time, so a very long group needs no more memory than a short one."""
    n = len(first) - 1
    out = np.zeros(n, np.uint64)
    i = 0
    while i < n:
        j = int(np.searchsorted(first, first[i] + SLAB, "right")) - 1
        if j <= i:
            a, b = int(first[i]), int(first[i + 1])
            count = np.zeros(64, np.int64)
            for c in range(a, b, SLAB):
                count += bits(h[c : min(b, c + SLAB)]).sum(0, dtype=np.int64)
            out[i] = pack((2 * count > b - a)[None, :])[0]
            i += 1
            continue
        j = min(j, n)
        a, b = int(first[i]), int(first[j])
        sizes = np.diff(first[i : j + 1])
        some = np.flatnonzero(sizes)
        if len(some):
            count = counted(h[a:b], first[i:j][some] - a, sizes[some])
            out[i + some] = pack(2 * count > sizes[some][:, None])
        i = j
    return out


#: SPREAD[x] has bit b of the byte x in its b-th byte.
SPREAD = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint64) << (8 * np.arange(8)).astype(np.uint64)).sum(1, dtype=np.uint64)


def counted(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many hashes of each non-empty, adjoining group have each bit set, as rows of 64 counts.

    Eight counters share a 64-bit word; pieces of at most 255 hashes can't overflow them."""
    parts = -(-sizes // 255)
    group = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = starts[group] + 255 * nth
    by = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    out = np.empty((len(starts), 64), np.int64)
    begins = np.cumsum(parts) - parts
    for b in range(8):
        lanes = np.add.reduceat(SPREAD[by[:, b]], cut).view(np.uint8).reshape(-1, 8)
        out[:, 8 * b : 8 * b + 8] = np.add.reduceat(lanes, begins, axis=0, dtype=np.int64)
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

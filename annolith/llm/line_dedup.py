"""Fuzzy line dedup: SimHash, tables of least features, edit similarity, connected groups.

1. Each line is normalised to lower-case words. Its features are those of more than
   three bytes, or all if fewer than three are; of a line of under SHORT words, the
   runs of three bytes. It is fingerprinted over its features.
   Equal normalised lines are one line from here on, with its first occurrence.
2. Each of TABLES tables takes as key the least of the features under LEAST orders:
   lines that share a share j of their features meet in a table with probability
   j ** LEAST. Blocks of fingerprints can't do this: a word changed in ten moves ten bits.
3. Lines with a partner within RADIUS bits under a key bring their text there and are
   verified by edit similarity, against one line of each group found so far
   first: a group of near copies costs a comparison a line, not one a pair.
4. Of each connected group the occurrence first in order of document and line
   stays.

All pairs of lines that share a key have their fingerprints compared, however many do:
the lines of a key that more than CHUNK of them share are dealt to chunks, and each pair
of chunks is a group of its own. Whether two lines are linked doesn't depend on the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chaining import Seen, row_hashes
from .cluster import connected_components, drop, in_bitmap, key_bitmap, mapped, release, slices, stage, whole_runs
from .textkit import Hasher, Words, byte_table, majority, mix, runs, utf8, within

RADIUS, TABLES, LEAST, SHORT, CHUNK = 20, 8, 3, 6, 8192


def orders() -> np.ndarray:
    """Odd factors, an order of hashes each, of the tables."""
    return mix(np.arange(1, 1 + TABLES * LEAST, dtype=np.uint64)).reshape(TABLES, LEAST) | np.uint64(1)


def spans_of(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions first[i] .. first[i] + sizes[i] - 1 of every i, in order."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def tokens_in_tables(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The key of each non-empty group of hashes in each table, 32 bits."""
    out = np.empty((len(first) - 1, TABLES), np.uint32)
    if len(out):
        for t, factors in enumerate(orders()):
            key = np.zeros(len(out), np.uint64)
            for factor in factors:
                key = mix(key + np.minimum.reduceat(h * factor, first[:-1]))
            out[:, t] = key >> np.uint64(32)
    return out


def packed(marks: np.ndarray) -> pa.Array:
    """Rows of keys as binary values."""
    width = 4 * TABLES
    return pa.Array.from_buffers(pa.binary(), len(marks), [None, pa.py_buffer(np.arange(0, width * (len(marks) + 1), width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(marks))])


def unpacked(column) -> np.ndarray:
    """The rows of packed(), none of them null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, TABLES), np.uint32)
    return np.frombuffer(data, np.uint8, 4 * TABLES * len(column), int(np.frombuffer(offsets, np.int32)[column.offset])).view(np.uint32).reshape(-1, TABLES)


def odd_majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each group of word hashes; an even number of words has its last word pair as one feature more, so that no bit is a tie."""
    sizes = np.diff(first)
    even = np.flatnonzero((sizes > 0) & (sizes % 2 == 0))
    at = first[even + 1]
    pair = mix(h[at - 2] * np.uint64(3) + h[at - 1])
    more = np.zeros(len(sizes), np.int64)
    more[even] = 1
    return majority(np.insert(h, at, pair), first + np.concatenate([[0], np.cumsum(more)]))


class Lines:
    """The lines of a run of rows that have a word: row, number within the row, key of the normalised line."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, hasher: Hasher, table: np.ndarray):
        cuts = np.flatnonzero(raw == 10) + 1
        begins = np.union1d(off[:-1], cuts[cuts < len(raw)] if len(raw) else cuts)
        begins = begins[begins < len(raw)]
        words = Words(raw, np.append(begins, len(raw)), table)
        self.words, self.h = words, hasher.spans(words.data, words.starts, words.ends)
        row = np.searchsorted(off, begins, "right") - 1
        number = np.arange(len(begins)) - np.searchsorted(begins, off[row])
        self.n = np.diff(words.first)
        self.some = np.flatnonzero(self.n)
        self.row, self.number, self.key = row[self.some], number[self.some], row_hashes(self.h, words.first)[self.some]

    def features(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the features of the lines `at`, and where each line's begin, with the end."""
        words, n = self.words, self.n[self.some[at]]
        w = spans_of(words.first[self.some[at]], n)
        row = np.repeat(np.arange(len(at)), n)
        # short words are mostly function words, which would make all lines of a language alike
        long = words.ends[w] - words.starts[w] > 3
        long |= (np.bincount(row, long, len(at)) < 3)[row]
        # a word changed in a short line leaves too few of its words
        short = n < SHORT
        long &= ~short[row]
        few = np.flatnonzero(short[row])
        grams, line = self.byte_runs(w[few], row[few])
        sizes = np.bincount(line, minlength=len(at)) + np.bincount(row[long], minlength=len(at))
        first = np.concatenate([[0], np.cumsum(sizes)])
        of = np.empty(int(first[-1]), np.uint64)
        of[spans_of(first[:-1][~short], sizes[~short])] = mix(self.h[w[long]])
        of[spans_of(first[:-1][short], sizes[short])] = grams
        return of, first

    def byte_runs(self, at: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all three bytes in a row of the normalised lines of these words, with a blank at both ends; and the line of each."""
        words = self.words
        last = np.append(line[1:] != line[:-1], True)[: len(at)]
        sizes = words.ends[at] - words.starts[at] + 1 + last
        begins = np.cumsum(sizes) - sizes
        text = np.full(int(sizes.sum()), 32, np.uint64)
        text[spans_of(begins + 1, words.ends[at] - words.starts[at])] = words.data[spans_of(words.starts[at], words.ends[at] - words.starts[at])]
        row = np.repeat(line, sizes)
        ok = within(row, 3)
        grams = text[:-2] | text[1:-1] << np.uint64(8) | text[2:] << np.uint64(16)
        return mix(mix(grams[ok] + np.uint64(1))), row[: len(ok)][ok]

    def normal(self, i: int) -> str:
        """The normalised text of the i-th line."""
        words = self.words
        a, b = words.first[self.some[i]], words.first[self.some[i] + 1] - 1
        return b" ".join(words.data[words.starts[a] : words.ends[b]].tobytes().replace(b"\0", b" ").split()).decode()

    def normals(self, at: np.ndarray) -> pa.Array:
        """The normalised texts of the lines `at`."""
        words, n = self.words, self.n[self.some[at]]
        w = spans_of(words.first[self.some[at]], n)
        lengths = words.ends[w] - words.starts[w]
        last = np.cumsum(n) - 1
        sizes = lengths + 1  # a blank after each word but the last
        sizes[last] -= 1
        ends = np.cumsum(sizes)
        text = np.full(int(sizes.sum()), 32, np.uint8)
        text[spans_of(ends - sizes, lengths)] = words.data[spans_of(words.starts[w], lengths)]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends[last]]).astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())


def line_runs(column: pa.Array, hasher: Hasher, table: np.ndarray):
    """(first row, Lines) of runs of rows."""
    raw, off = utf8(pc.utf8_lower(column))
    for lo, hi in runs(off):
        yield lo, Lines(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], hasher, table)


def normal_table() -> np.ndarray:
    t = byte_table(True)
    t[10] = 0
    return t


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line, key, print, marks) of every line with a word, numbered from 0 in its document with all lines; print and marks are null where the task had the key before."""

    def make():
        hasher, table, seen = Hasher(), normal_table(), Seen()

        def run(batch):
            out = []
            for lo, x in line_runs(batch.column(1), hasher, table):
                new = seen.new(x.key)
                of, first = x.features(np.flatnonzero(new))
                out.append((lo + x.row, x.number.astype(np.int32), x.key.view(np.int64), new, odd_majority(of, first).view(np.int64), tokens_in_tables(of, first)))
            row, number, key, new, prints, marks = (np.concatenate(c) for c in zip(*out, strict=True))
            at = pa.array(np.where(new, np.cumsum(new) - 1, 0), mask=~new)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(number), pa.array(key), pa.array(prints).take(at), packed(marks).take(at)], ["doc_id", "line", "key", "print", "marks"])

        return run

    return mapped(docs, make, "doc_id long, line int, key long, print long, marks binary")


def texts_of(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """(key, normal, marks): the normalised text and the tables' keys of lines that the bitmap may hold."""

    def make():
        hasher, table, seen = Hasher(), normal_table(), Seen()

        def run(batch):
            keys, texts, marks = [], [], []
            for _, x in line_runs(batch.column(1), hasher, table):
                held = np.flatnonzero(in_bitmap(bitmap, x.key))
                held = held[seen.new(x.key[held])]
                if len(held):
                    keys.append(x.key[held].view(np.int64))
                    texts.append(x.normals(held))
                    marks.append(tokens_in_tables(*x.features(held)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.concat_arrays(texts), packed(np.concatenate(marks))], ["key", "normal", "marks"]) if keys else None

        return run

    return mapped(docs, make, "key long, normal string, marks binary").groupBy("key").agg(F.first("normal").alias("normal"), F.first("marks").alias("marks"))


def shared_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance in characters, by bit rows; over `most` means only that it is over."""
    if a == b:
        return 0
    i = shared_prefix(a, b)
    a, b = a[i:], b[i:]
    j = shared_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - j], b[: len(b) - j]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    # rows of a within the diagonals that a way of `most` edits can reach and come back from, bit 0 the uppermost, a row down with each column
    n, m, most = len(a), len(b), min(most, max(len(a), len(b)))
    low, high = (most - n + m) // 2, (most + n - m) // 2
    where: dict[str, int] = {}
    for k, x in enumerate(a, low):
        where[x] = where.get(x, 0) | 1 << k
    full, end = (1 << low + high + 1) - 1, 1 << low + n - m
    up, down, score = full >> low << low, 0, max(0, n - m)
    for k, y in enumerate(b):
        eq = where.get(y, 0) >> k & full
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        ph, mh = down | (full ^ (diagonal | up)), diagonal & up
        if not diagonal & end:  # along the last cell's diagonal, where distances don't fall
            score += 1
            if score > most:
                return score
        diagonal >>= 1
        up, down = mh | (full ^ (diagonal | ph)), diagonal & ph
    return score


#: Where words differ: how many of each text to pass over, the nearest first.
PASS = [(1, 1), (1, 0), (0, 1), *((d, t - d) for t in range(2, 6) for d in range(t + 1) if (d, t - d) != (1, 1))]


def rough_distance(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance, word by word: where words differ, up to the nearest word in which the texts meet again."""
    x, y = a.split(" "), b.split(" ")
    n, m = len(x), len(y)
    x += [None] * 6
    y += [""] * 6
    i, j, cost = 0, 0, 0
    while cost <= most:
        while i < n and x[i] == y[j]:
            i, j = i + 1, j + 1
        if i >= n or j >= m:
            return cost + sum(len(w) + 1 for w in x[i:n]) + sum(len(w) + 1 for w in y[j:m])
        for di, dj in PASS:
            if x[i + di] == y[j + dj]:
                break
        else:
            di = dj = 1
        di, dj = min(di, n - i), min(dj, m - j)
        cost += max(sum(map(len, x[i : i + di])) + di, sum(map(len, y[j : j + dj])) + dj)
        i, j = i + di, j + dj
    return cost


def most_edits(a: str, b: str, least: float) -> int:
    """The greatest distance of which 1 - distance / longer length is at least `least`."""
    return int((1 - least) * max(len(a), len(b)) + 1e-9)


#: Classes of characters that are counted: of lower-case Latin text, one for each letter.
CLASSES = 32


def letters_of(texts: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    """How many characters of each class the texts `at` have, a row each."""
    out = np.empty((len(at), CLASSES), np.int32)
    raw, off = utf8(texts.take(pa.array(at)))
    for lo, hi in runs(off):
        data = raw[off[lo] : off[hi]]
        row = np.repeat(np.arange(0, CLASSES * (hi - lo), CLASSES), np.diff(off[lo : hi + 1]))
        whole = (data & 0xC0) != 0x80  # the bytes that begin a character; those after a first byte tell most of another script's characters apart
        kind = data & (CLASSES - 1)
        more = np.flatnonzero(~whole[1:] & whole[:-1])
        kind[more] = kind[more + 1] & (CLASSES - 1)
        out[lo:hi] = np.bincount(row[whole] + kind[whole], minlength=CLASSES * (hi - lo)).reshape(-1, CLASSES)
    return out


def apart_at_least(letters: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distances of the texts a and b: an edit adds one character, takes one or both."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), LOOK):
        d = letters[a[lo : lo + LOOK]] - letters[b[lo : lo + LOOK]]
        more = np.maximum(d, 0).sum(1)
        out[lo : lo + LOOK] = np.maximum(more, more - d.sum(1))
    return out


#: Pairs that are compared side by side, the fewest for which that pays, and words of memory for their characters' places.
SIDE, FEW, ROOM = 2048, 12, 4 << 20
#: Steps between two looks at which pairs are over their number.
CHECK = 48


def places(texts: list[np.ndarray], letters: int, blocks: int) -> np.ndarray:
    """[block, text * letters + letter]: in which of the block's 64 characters the letter stands."""
    sizes = np.array([len(t) for t in texts])
    pos = spans_of(np.zeros(len(texts), np.int64), sizes)
    at = (pos >> 6) * (len(texts) * letters) + np.repeat(np.arange(len(texts)) * letters, sizes) + np.concatenate(texts)
    out = np.zeros(blocks * len(texts) * letters, np.uint64)
    order = np.argsort(pos & 63, kind="stable")
    ends = np.searchsorted((pos & 63)[order], np.arange(65))
    for bit in range(64):  # a place of a block has one letter
        out[at[order[ends[bit] : ends[bit + 1]]]] |= np.uint64(1 << bit)
    return out.reshape(blocks, -1)


def lower_bound(score: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The least value of each column of blocks, the rows above the blocks included, by the steps down of their rows and the scores of their last ones."""
    u, d = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) for x in (up, down))
    step = u.astype(np.int32) << 8 | d
    total, most = STEP_SUM[step], STEP_MOST[step]
    # what the rows below a byte add
    below = np.cumsum(total[..., ::-1], axis=-1, dtype=np.int32)[..., ::-1] - total
    return (score - np.maximum(0, (below + most).max(-1))).min(0)


#: Of a byte of steps up and one of steps down: their sum, and the greatest sum of its last ones.
_UP, _DOWN = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1 for _ in range(2))
STEP_SUM = (_UP.sum(1)[:, None] - _DOWN.sum(1)).astype(np.int8).ravel()
STEP_MOST = np.cumsum((_UP[:, None] - _DOWN[None]).astype(np.int8), axis=-1, dtype=np.int8).max(-1).ravel()


def distances(a: list[np.ndarray], b: list[np.ndarray], letters: int, most: np.ndarray, alone=None) -> np.ndarray:
    """Edit distances of texts of letter numbers, no text empty, side by side; a distance over the pair's `most` may be any number over it.

    Rows are a's characters in blocks of 64, and each step takes every block one column on, a column behind the
    block above it. A block reads the columns of the diagonals that a way of `most` edits can reach and come back
    from; what lies outside counts as reached from above or from the left alone, which no such way does. Pairs all
    of whose ways are over `most` where they stand are looked for every CHECK steps, and left when they are many.
    alone: gives the distance of one pair, by its number; it takes over where few pairs are left of many steps."""
    one, full = np.uint64(1), ~np.uint64(0)
    n, m = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    blocks, width = (int(n.max()) + 63) >> 6, int(m.max())
    texts = {id(t): t for t in a}
    number = {x: i for i, x in enumerate(texts)}
    table = places(list(texts.values()), letters, blocks)
    column = np.zeros((len(b), width), np.int64)
    column[np.arange(width) < m[:, None]] = np.concatenate(b)
    column = np.ascontiguousarray(column.T) + np.array([number[id(t)] for t in a]) * letters
    offset = np.arange(blocks)[:, None] * table.shape[1]
    table = table.ravel()
    k = np.arange(blocks)
    # d diagonals off to one side, and back to the end, are d edits and |m - n - d| more
    right, left = int(np.max((most + m - n) // 2)), int(np.max((most - m + n) // 2))
    begins, ends = np.maximum(0, 64 * k - max(left, 0) - 1), np.minimum(width, 64 * (k + 1) + max(right, 0))  # columns of each block
    plus, minus = np.ones((blocks + 1, len(a)), np.uint64), np.zeros((blocks + 1, len(a)), np.uint64)  # steps of the row above each block
    up, down, score = np.full((blocks, len(a)), full), np.zeros((blocks, len(a)), np.uint64), np.zeros((blocks, len(a)), np.int64)  # score: of the block's last row
    score[0] = 64
    at = np.empty(up.shape, np.int64)
    eq_, xv_, xh_, ph_, mh_ = (np.empty(up.shape, np.uint64) for _ in range(5))
    out = most + 1
    home = (n - 1) >> 6
    when = m - 1 + home
    ids, last, halts = np.arange(len(a)), int(when.max()), set(when.tolist())
    lo = hi = 0
    for t in range(last + 1):
        while lo < hi and t - lo >= ends[lo]:
            lo += 1
        while hi + 1 < blocks and t - hi - 1 >= begins[hi + 1]:
            hi += 1
            score[hi] = score[hi - 1] + 64
            if t - hi:  # the block above is a column ahead, but where both begin
                score[hi] -= plus[hi].view(np.int64)
                score[hi] += minus[hi].view(np.int64)
            else:
                score[hi] = 64 * (hi + 1)
        if not lo or t - lo >= ends[lo - 1]:
            plus[lo].fill(1)
            minus[lo].fill(0)
        r = slice(lo, hi + 1)
        u, d, eq, xv, xh, ph, mh = up[r], down[r], eq_[r], xv_[r], xh_[r], ph_[r], mh_[r]
        if t - lo < width:
            np.add(column[t - hi : t - lo + 1][::-1], offset[r], out=at[r])
        np.take(table, at[r], out=eq, mode="clip")
        np.bitwise_or(eq, d, out=xv)
        np.bitwise_or(eq, minus[r], out=eq)
        np.bitwise_and(eq, u, out=xh)
        np.add(xh, u, out=xh)
        np.bitwise_xor(xh, u, out=xh)
        np.bitwise_or(xh, eq, out=xh)
        np.bitwise_or(xh, u, out=ph)
        np.invert(ph, out=ph)
        np.bitwise_or(ph, d, out=ph)
        np.bitwise_and(u, xh, out=mh)
        np.left_shift(ph, one, out=xh)
        np.bitwise_or(xh, plus[r], out=xh)
        np.left_shift(mh, one, out=eq)
        np.bitwise_or(eq, minus[r], out=eq)
        below = slice(lo + 1, hi + 2)
        np.right_shift(ph, 63, out=plus[below])
        np.right_shift(mh, 63, out=minus[below])
        np.bitwise_or(xv, xh, out=u)
        np.invert(u, out=u)
        np.bitwise_or(u, eq, out=u)
        np.bitwise_and(xh, xv, out=d)
        score[r] += plus[below].view(np.int64)
        score[r] -= minus[below].view(np.int64)
        if t in halts:
            for i in np.flatnonzero(when[ids] == t).tolist():
                x = ids[i]
                b_, rest = int(home[x]), full << np.uint64((int(n[x]) - 1) & 63) << one  # the rows after the text
                if lo <= b_ <= hi:
                    out[x] = score[b_, i] - int(np.bitwise_count(up[b_, i] & rest)) + int(np.bitwise_count(down[b_, i] & rest))
        if t % CHECK == CHECK - 1 and t < last:
            # a way goes on from these columns, or from a neighbour of theirs
            keep = (when[ids] > t) & (lower_bound(score[r], up[r], down[r]) - 1 <= most[ids])
            if 4 * np.count_nonzero(keep) <= 3 * len(ids):
                ids = ids[keep]
                last = int(when[ids].max()) if len(ids) else t
                if alone and len(ids) * (last + 1) <= FEW * (last - t):
                    for i in ids.tolist():
                        out[i] = alone(i)
                    break
                if t >= last:
                    break
                up, down, score, plus, minus = (np.ascontiguousarray(x[:, keep]) for x in (up, down, score, plus, minus))
                at, column = np.ascontiguousarray(at[:, keep]), np.ascontiguousarray(column[:, keep])
                eq_, xv_, xh_, ph_, mh_ = (np.empty(up.shape, np.uint64) for _ in range(5))
        if t >= last:
            break
    return out


def within_edits(pairs: list[tuple[str, str, int]]) -> list[bool]:
    """Whether the distance of each pair is at most its number, in characters; pairs of like length side by side, what is left one by one."""
    found = [False] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: max(len(pairs[i][0]), len(pairs[i][1])))
    texts = {t: np.frombuffer(t.encode("utf-32-le"), np.uint32) for a, b, _ in pairs for t in (a, b)}
    known = np.unique(np.concatenate(list(texts.values()))) if pairs else np.zeros(0, np.uint32)
    codes = {t: np.searchsorted(known, x) for t, x in texts.items()}
    lo = 0
    while lo < len(order):
        shortest = max(map(len, pairs[order[lo]][:2]))
        hi = lo
        while hi < len(order) and hi - lo < SIDE:
            longest = max(map(len, pairs[order[hi]][:2]))
            if longest > 2 * shortest + 64 or (hi + 1 - lo) * (len(known) * ((longest + 63) >> 6) + longest) > ROOM:
                break
            hi += 1
        hi = max(hi, lo + 1)
        some = order[lo:hi]
        if len(some) < FEW:
            for i in some:
                found[i] = edit_distance(*pairs[i]) <= pairs[i][2]
        else:
            got = distances([codes[pairs[i][0]] for i in some], [codes[pairs[i][1]] for i in some], len(known), np.array([pairs[i][2] for i in some]), lambda i: edit_distance(*pairs[some[i]]))
            for i, x in zip(some, got.tolist(), strict=True):
                found[i] = x <= pairs[i][2]
        lo = hi
    return found


#: Bounds of the fingerprints' distance, the nearest pairs first; pairs that are held at once, and pairs between two looks at what is connected.
STEPS, BLOCK, LOOK = (8, RADIUS), 1 << 20, 1 << 14


def near_pairs(groups: np.ndarray, prints: np.ndarray, part: np.ndarray, low: int = -1, high: int = RADIUS):
    """(left, right) blocks of the pairs of rows, sorted by group, of one group and over `low` and up to `high` bits apart. part: 0 or 1 where only rows of different parts meet, else -1."""
    at, left, right, size = np.arange(len(prints)), [], [], 0
    for d in range(1, len(prints)):
        at = at[at + d < len(prints)]
        at = at[groups[at] == groups[at + d]]
        if not len(at):
            break
        bits = np.bitwise_count(prints[at] ^ prints[at + d])
        near = at[(bits <= high) & (bits.astype(np.int16) > low) & ((part[at] < 0) | (part[at] != part[at + d]))]
        left.append(near)
        right.append(near + d)
        size += len(near)
        if size > BLOCK:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def parts_of(rows: pa.Table) -> np.ndarray:
    """Which of its slot's two chunks each row is in, -1 where the slot has but one."""
    slot = rows.column("slot").to_numpy()
    return np.where(slot // CHUNKS == slot % CHUNKS, -1, rows.column("part").to_numpy())


def group_numbers(rows: pa.Table) -> np.ndarray:
    """The number of the bucket and slot of sorted rows."""
    bucket, slot = rows.column("bucket").to_numpy(), rows.column("slot").to_numpy()
    return np.concatenate([[0], np.cumsum((bucket[1:] != bucket[:-1]) | (slot[1:] != slot[:-1]))])


def partnered(batches):
    """Sorted (bucket, slot, key, print, part) -> those of its rows that have a partner in their group within RADIUS."""
    for rows in whole_runs(batches, ["bucket", "slot"]):
        has = np.zeros(rows.num_rows, bool)
        for left, right in near_pairs(group_numbers(rows), rows.column("print").to_numpy().view(np.uint64), parts_of(rows)):
            has[left] = has[right] = True
        if has.any():
            yield from rows.filter(pa.array(has)).combine_chunks().to_batches()


class Links:
    """Lines that are connected, and pairs that wait to be compared side by side."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.waiting: list[tuple[int, int, str, str, int]] = []
        self.size, self.edges = 0, []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def link(self, x: int, y: int) -> None:
        a, b = sorted((self.root(x), self.root(y)))
        if a != b:  # the groups' least lines: nearly the stars that the rounds after it make
            self.up[b] = a
            self.edges.append((a, b))

    def compare(self, x: int, y: int, a: str, b: str, least: float, bound: int) -> None:
        """bound: a lower bound of the distance; if it's high, the rough one is hardly ever low enough, and only the exact one tells."""
        most = most_edits(a, b, least)
        if 2 * bound <= most and rough_distance(a, b, most) <= most:
            self.link(x, y)
            return
        self.waiting.append((x, y, a, b, most))
        self.size += len(a) + len(b)
        if len(self.waiting) >= 4 * SIDE or self.size > ROOM:
            self.settle()

    def settle(self) -> None:
        some = [p for p in self.waiting if self.root(p[0]) != self.root(p[1])]
        self.waiting, self.size = [], 0
        for (x, y, *_), near in zip(some, within_edits([p[2:] for p in some]), strict=True):
            if near:
                self.link(x, y)

    def taken(self) -> pa.RecordBatch:
        """The edges found since the last call. What many lines before were connected by is forgotten."""
        out = pa.RecordBatch.from_arrays([pa.array([e[i] for e in self.edges], pa.int64()) for i in (0, 1)], ["u", "v"])
        self.edges = []
        if len(self.up) > 500_000:
            self.up.clear()
        return out


def linked(batches, least: float):
    """Sorted (bucket, slot, key, print, part, normal, marks) -> edges (u, v) that connect what pairs within RADIUS and of edit similarity `least` connect.

    A pair is compared in its first common table alone, the nearest fingerprints first, and not if its lines are
    connected already: a group of near copies costs about a comparison a line."""
    links = Links()
    for rows in whole_runs(batches, ["bucket", "slot"]):
        prints, marks = rows.column("print").to_numpy().view(np.uint64), unpacked(rows.column("marks"))
        groups, part = group_numbers(rows), parts_of(rows)
        size = pc.utf8_length(rows.column("normal")).to_numpy()
        table = (rows.column("bucket").to_numpy().view(np.uint64) >> np.uint64(60)).astype(np.int64)
        texts, keys = rows.column("normal"), rows.column("key").to_pylist()
        low = -1
        for high in STEPS:
            for left, right in near_pairs(groups, prints, part, low, high):
                fits = np.abs(size[left] - size[right]) <= (1 - least) * np.maximum(size[left], size[right]) + 1e-9
                left, right = left[fits], right[fits]
                before = np.zeros(len(left), bool)
                for t in range(TABLES):
                    before |= (marks[left, t] == marks[right, t]) & (t < table[left])
                left, right = left[~before], right[~before]
                there, where = np.unique(np.concatenate([left, right]), return_inverse=True)
                a, b = where[: len(left)], where[len(left) :]
                bound = apart_at_least(letters_of(texts, there), a, b)
                fits = bound <= (1 - least) * np.maximum(size[left], size[right]) + 1e-9
                left, right, bound = left[fits], right[fits], bound[fits]
                order = np.argsort(np.bitwise_count(prints[left] ^ prints[right]), kind="stable")
                left, right, bound = left[order], right[order], bound[order]
                for a in range(0, len(left), LOOK):
                    some, other, low_ = left[a : a + LOOK], right[a : a + LOOK], bound[a : a + LOOK]
                    if len(left) > LOOK:  # most pairs of a large group are connected by the nearest
                        root = np.array([links.root(k) for k in keys])
                        apart = root[some] != root[other]
                        some, other, low_ = some[apart], other[apart], low_[apart]
                    for i, j, d in zip(some.tolist(), other.tolist(), low_.tolist(), strict=True):
                        if links.root(keys[i]) != links.root(keys[j]):
                            links.compare(keys[i], keys[j], texts[i].as_py(), texts[j].as_py(), least, d)
            low = high
        if links.edges:
            yield links.taken()
    links.settle()
    yield links.taken()


def bucket_numbers(marks: np.ndarray, t: int) -> np.ndarray:
    """The bucket of each line in table t, whose number is the bucket's top four bits."""
    return mix(marks[:, t] + np.uint64(t << 32)) >> np.uint64(4) | np.uint64(t << 60)


def bucket_sizes(distinct: DataFrame) -> DataFrame:
    """(bucket, n) of the buckets of more than one line. Nearly all are of one, so that they are counted in a batch, where a large one becomes a row, and then where they are dealt to."""

    def make():
        def run(batch):
            marks = unpacked(batch.column(0)).astype(np.uint64)
            bucket, n = np.unique(np.concatenate([bucket_numbers(marks, t) for t in range(TABLES)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(n)], ["bucket", "n"])

        return run

    def summed(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            bucket, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(bucket)
            bucket = bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
            total = np.add.reduceat(n[order], first) if len(first) else n
            many = total > 1
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first][many]), pa.array(total[many])], ["bucket", "n"])

    return mapped(distinct.select("marks"), make, "bucket long, n long").repartition("bucket").mapInArrow(summed, "bucket long, n long")


def buckets_of(distinct: DataFrame, bitmap: bytes) -> DataFrame:
    """(bucket, key, print) of every line under the key of every table, of the buckets that the bitmap may hold."""

    def make():
        def run(batch):
            marks = unpacked(batch.column(2)).astype(np.uint64)
            at, buckets = [], []
            for t in range(TABLES):
                b = bucket_numbers(marks, t)
                keep = np.flatnonzero(in_bitmap(bitmap, b))
                at.append(keep)
                buckets.append(b[keep])
            at = pa.array(np.concatenate(at))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["bucket", "key", "print"])

        return run

    return mapped(distinct.select("key", "print", "marks"), make, "bucket long, key long, print long")


#: More than a bucket has chunks: a slot is the lesser of its two times this, and the greater.
CHUNKS = 100_000_000


def grouped(distinct: DataFrame) -> DataFrame:
    """(bucket, slot, key, print, part) of the lines that share a bucket: one slot for up to CHUNK lines, else a slot for each pair of chunks that the row's chunk is in, part 1 being the greater of the two."""
    sizes = stage(bucket_sizes(distinct))
    rows = buckets_of(distinct, key_bitmap(sizes, "bucket"))
    # at most TABLES buckets for every CHUNK lines
    over = stage(sizes.filter(F.col("n") > CHUNK).select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("k")))
    drop(sizes)
    release(distinct.sparkSession)
    chunk = F.pmod(F.xxhash64("key"), "k").cast("int")
    slot = lambda j: F.struct((F.least(j, chunk).cast("long") * CHUNKS + F.greatest(j, chunk)).alias("slot"), (j < chunk).cast("byte").alias("part"))
    one = F.array(F.struct(F.lit(0).cast("long").alias("slot"), F.lit(0).cast("byte").alias("part")))
    slots = F.when(F.col("k").isNull(), one).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1), slot))
    return rows.join(F.broadcast(over), "bucket", "left").select("bucket", "key", "print", F.explode(slots).alias("s")).select("bucket", "s.slot", "key", "print", "s.part")


def similar_lines(docs: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) between keys of lines that meet in a table, are within RADIUS and of edit similarity `least`, as many as connect them. docs: (doc_id, text). Staged."""
    spark = docs.sparkSession
    together = lambda d: d.repartition("bucket", "slot").sortWithinPartitions("bucket", "slot", "key")
    suspects = stage(together(grouped(distinct)).mapInArrow(partnered, "bucket long, slot long, key long, print long, part byte"))
    release(spark)
    texts = stage(texts_of(docs, key_bitmap(suspects, "key")))
    release(spark)
    # the narrow side is hashed (a key has a row for each of its slots), so that no texts are sorted
    full = suspects.hint("shuffle_hash").join(texts, "key").select("bucket", "slot", "key", "print", "part", "normal", "marks")
    edges = stage(together(full).mapInArrow(lambda batches: linked(batches, least), "u long, v long"))
    drop(suspects)
    drop(texts)
    release(spark)
    return edges


def removed_lines(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, removed): the numbers of the lines that go, of documents that lose any. docs: (doc_id, text)."""
    wide = stage(lines_of(docs))
    distinct = stage(wide.groupBy("key").agg(F.min("print").alias("print"), F.first("marks", True).alias("marks"), F.min(F.struct("doc_id", "line")).alias("at"), F.count("*").alias("n")))
    lines = stage(wide.select("doc_id", "line", "key"))  # without what only the tables need
    drop(wide)
    release(docs.sparkSession)
    roots = connected_components(similar_lines(docs, distinct, least))
    named = distinct.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").filter("n > 1 or root is not null").select("key", "at", F.coalesce("root", "key").alias("root"))
    # both sides are staged, so that a group with most of the lines is a join that can be split
    named = stage(named)
    first = stage(named.groupBy("root").agg(F.min("at").alias("stays")))
    stays = stage(named.join(first, "root").select("key", "stays"))
    gone = lines.join(stays, "key").filter(~F.struct("doc_id", "line").eqNullSafe(F.col("stays")))
    return gone.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set("line").alias("removed"))


def dedup_lines(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their texts without repeated lines, and n_lines and n_removed beside them.

    Lines are the parts between \\n. Two lines are linked if their normalised forms (lower case, words of letters and
    digits) are equal, or meet in a table, have SimHashes within RADIUS bits and an edit similarity of at least `least`; of every
    connected group one occurrence stays, that of the smallest (doc_id, line number). Lines without a word are never
    repeats. Texts and lines of any length are read whole. A null text stays null with 0 lines. Rows that share an id are one document; rows without an id lose no
    line. Columns of docs named n_lines or n_removed are replaced. An empty table gives an empty result."""
    docs = docs.drop(*[c for c in ("n_lines", "n_removed") if c not in (id_col, text_col)])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gone = removed_lines(source, least).select(F.col("doc_id").alias("_gone_id"), F.col("removed").alias("_gone"))
    joined = docs.join(gone.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col("_gone_id"), "left").drop("_gone_id")
    names = docs.columns

    def run(batches):
        for batch in slices(batches):
            texts, n, m = [], [], []
            for text, gone in zip(batch.column(names.index(text_col)), batch.column(len(names)).to_pylist(), strict=True):
                x = text.as_py()
                n.append(0 if x is None else x.count("\n") + 1)
                if gone and x is not None:
                    drop = set(gone)
                    x = "\n".join(line for i, line in enumerate(x.split("\n")) if i not in drop)
                texts.append(x)
                m.append(len(gone or ()))
            cols = [pa.array(texts, pa.string()) if name == text_col else batch.column(i) for i, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(m, pa.int64())], [*names, "n_lines", "n_removed"])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_removed long"
    return joined.mapInArrow(run, schema)

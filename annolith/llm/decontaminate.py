"""Benchmark decontamination by SimHash of item-sized windows.

Texts are normalised to lower-case words; a feature is a shingle of K words.
Windows of every item length are fingerprinted over their features.  Multi-index
Hamming blocks find every item of that length whose fingerprint is within the
radius: a distance of at most RADIUS over BLOCKS blocks leaves some block within
RADIUS // BLOCKS bits, and all such values of a block are looked up.  Candidates
are verified by the exact similarity of weighted shingles.

A window of which too few shingles stand in any item can't reach the similarity
with one of them, so it isn't fingerprinted: that loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import in_bitmap, key_bitmap, mapped, slices, stage
from .textkit import Hasher, Words, byte_table, majority, mix, runs, shingles, utf8, within

K, BLOCKS, RADIUS = 5, 4, 15
#: The masks of at most RADIUS // BLOCKS bits of a block.
MASKS = np.array([sum(1 << b for b in at) for n in range(RADIUS // BLOCKS + 1) for at in combinations(range(64 // BLOCKS), n)], np.uint16)


def word_hashes(column: pa.Array, hasher: Hasher, table: np.ndarray) -> Iterator[tuple[int, Words, np.ndarray]]:
    """(first row, words, their hashes) of runs of rows, of lower-cased text."""
    raw, off = utf8(pc.utf8_lower(column))
    for lo, hi in runs(off):
        words = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], table)
        yield lo, words, hasher.spans(words.data, words.starts, words.ends)


def features(h: np.ndarray, k: int = K) -> np.ndarray:
    """Shingles of a word sequence; of a sequence of fewer than k words, the one shingle of all."""
    return shingles(h, min(k, len(h))) if len(h) else np.zeros(0, np.uint64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of each feature."""
    values, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(both[: len(a)], minlength=len(values)), np.bincount(both[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class Benchmark:
    """The items of one block, indexed by shingle and by Hamming blocks."""

    def __init__(self, ids: list[int], texts: list[str]):
        hasher, table = Hasher(), byte_table(True)
        self.ids, self.features, self.length = [], [], []
        for lo, words, h in word_hashes(pa.array(texts, pa.string()), hasher, table):
            for i in range(len(words.first) - 1):
                mine = h[words.first[i] : words.first[i + 1]]
                if len(mine):
                    self.ids.append(ids[lo + i])
                    self.features.append(features(mine))
                    self.length.append(len(mine))
        n = len(self.ids)
        first = np.concatenate([[0], np.cumsum([len(f) for f in self.features])]).astype(np.int64)
        flat = np.concatenate(self.features) if n else np.zeros(0, np.uint64)
        self.prints = majority(mix(flat), first)
        item = np.repeat(np.arange(n), np.diff(first))
        self.keys = np.unique(flat)
        #: Length and shingle size of the windows, and the sizes in features of an item of that length.
        self.kinds = sorted({(size, min(size, K)) for size in self.length})
        self.sizes = np.array(self.length, np.int64)
        self.short = sorted({x for x in self.length if x < K})
        self.bitmap = np.zeros(1 << 17, np.uint8)
        np.bitwise_or.at(self.bitmap, ((flat >> np.uint64(3)) & np.uint64((1 << 17) - 1)).astype(np.int64), np.uint8(1) << (flat & np.uint64(7)).astype(np.uint8))
        #: Of each block: items in order of its value, and where those of a value begin.
        self.tables = []
        for b in range(BLOCKS):
            value = self.block(self.prints, b)
            self.tables.append((np.argsort(value, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << 64 // BLOCKS))])))

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * (64 // BLOCKS)) & np.uint64((1 << 64 // BLOCKS) - 1)).astype(np.uint16)

    def hits(self, f: np.ndarray) -> np.ndarray:
        """Positions of features that some item has."""
        maybe = np.flatnonzero((self.bitmap[((f >> np.uint64(3)) & np.uint64((1 << 17) - 1)).astype(np.int64)] >> (f & np.uint64(7)).astype(np.uint8)) & 1)
        if not len(maybe) or not len(self.keys):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, f[maybe]), len(self.keys) - 1)
        return maybe[self.keys[at] == f[maybe]]

    def sharing(self, words: Words, h: np.ndarray) -> list[int]:
        """The rows of a run that share a feature with an item."""
        some: set[int] = set()
        for k in [K, *self.short]:
            f, ok = shingles(h, k), within(words.row, k)
            at = self.hits(f)
            some.update(words.row[at[ok[at]]].tolist())
        return sorted(some)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) of every pair within the radius, in order, by the block tables."""
        found = [np.zeros(0, np.int64)]
        for lo in range(0, len(prints), 256):
            for b, (items, first) in enumerate(self.tables):
                values = (self.block(prints[lo : lo + 256], b)[:, None] ^ MASKS).astype(np.int64)
                n = first[values + 1] - first[values]
                w, m = np.nonzero(n)
                n, begin = n[w, m], first[values[w, m]]
                w = np.repeat(w + lo, n)
                i = items[np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
                near = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
                found.append(w[near] * len(self.ids) + i[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    def matches(self, h: np.ndarray, least: float) -> list[tuple[int, float, int, int, int]]:
        """(item id, similarity, start word, words, Hamming distance) of each item that a document holds, its best window, of equal ones the first."""
        best: dict[int, tuple] = {}
        of_k: dict[int, tuple] = {}
        for size, k in self.kinds:
            if k not in of_k:
                f = shingles(h, k)
                held = np.zeros(len(f) + 1, np.int64)
                held[self.hits(f) + 1] = 1
                of_k[k] = f, np.cumsum(held)
            f, held = of_k[k]
            if not len(f) or not held[-1]:
                continue
            n = min(size, len(h)) - k + 1
            begin = np.arange(len(f) - n + 1)
            # the smaller counts sum up to s: s / (n + item - s) is `least` or more
            begin = begin[held[begin + n] - held[begin] >= least * (n + size - k + 1) / (1 + least) - 1e-9]
            for lo in range(0, len(begin), step := max(1, (1 << 15) // n)):
                at = begin[lo : lo + step]
                prints = majority(mix(f[at[:, None] + np.arange(n)].ravel()), np.arange(len(at) + 1) * n)
                for w, i in zip(*(x.tolist() for x in self.within_radius(prints)), strict=True):
                    if self.sizes[i] == size:
                        sim = weighted_similarity(f[at[w] : at[w] + n], self.features[i])
                        if sim >= least and sim > best.get(i, (0,))[0]:
                            best[i] = (sim, int(at[w]), min(size, len(h)), int(np.bitwise_count(prints[w] ^ self.prints[i])))
        return [(self.ids[i], *found) for i, found in sorted(best.items())]


def shared_shingles(benchmark: DataFrame, text_col: str) -> bytes:
    """A bitmap of the features of all items."""

    def make():
        hasher, table = Hasher(), byte_table(True)

        def run(batch):
            found = [np.zeros(0, np.uint64)]
            for _, words, h in word_hashes(batch.column(0), hasher, table):
                found += [features(h[a:b]) for a, b in zip(words.first, words.first[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], ["f"])

        return run

    return key_bitmap(stage(mapped(benchmark.select(F.col(text_col).cast("string").alias("text")), make, "f long")), "f")


def parted(docs: DataFrame, text_col: str, bitmap: bytes, sharing: bool) -> DataFrame:
    """The rows of docs that may share a feature with an item, or those that don't."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        hasher, table = Hasher(), byte_table(True)
        for batch in slices(batches):
            held = np.zeros(batch.num_rows, bool)
            for lo, words, h in word_hashes(batch.column(at).cast(pa.string()), hasher, table):
                for k in range(1, K + 1):  # of fewer words than K, an item is a feature of its own size
                    f = shingles(h, k)
                    held[lo + words.row[np.flatnonzero(in_bitmap(bitmap, f) & within(words.row, k))]] = True
            yield batch.filter(pa.array(held == sharing))

    return docs.mapInArrow(run, schema)


def oversized(benchmark: DataFrame, text_col: str, block_bytes: int) -> bool:
    """Whether the benchmark takes more than one block."""
    return (benchmark.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0) > block_bytes


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Benchmark]:
    """The items in blocks of at most block_bytes of text (or one longer item), read one after the other: what is held and sent at a time is bounded."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).dropna().toLocalIterator():
        if size and size + len(row[1]) > block_bytes:
            yield Benchmark(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
    if ids:
        yield Benchmark(ids, texts)


def find_contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, hamming): every benchmark item that a document holds, with its best window.

    similarity: weighted Jaccard of 5-word shingles, at least `least`; items of fewer words are one shingle and must
    be found whole. Null or wordless texts and items match nothing. Rows that repeat an id give their matches each;
    of equally good windows the first is given; texts of any length are read whole; empty tables give an empty result;
    other columns are ignored. A benchmark over block_bytes is worked through in blocks, each against the documents
    that share a shingle with any item."""
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long, hamming int"
    out = docs.sparkSession.createDataFrame([], schema)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if oversized(benchmark, item_text_col, block_bytes):
        source = stage(parted(source, "text", shared_shingles(benchmark, item_text_col), True))
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        out = out.unionByName(mapped(source, matcher(block, least), schema))
    return out


def matcher(block: Benchmark, least: float):
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int32())])

    def make():
        hasher, table = Hasher(), byte_table(True)

        def run(batch):
            rows = []
            for lo, words, h in word_hashes(batch.column(1), hasher, table):
                for i in block.sharing(words, h):
                    doc = batch.column(0)[lo + i].as_py()
                    rows += [(doc, *m) for m in block.matches(h[words.first[i] : words.first[i + 1]], least)]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t.type) for j, t in enumerate(arrow)], schema=arrow) if rows else None

        return run

    return make


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """docs without the documents that hold a benchmark item: a filter, without a shuffle.

    Nulls in any column, empty texts and repeated rows stay as they are, if they hold no item. A benchmark over
    block_bytes is worked through in blocks, each a filter of the documents that share a shingle with any item."""
    at, schema, rest = docs.columns.index(text_col), docs.schema, None
    if oversized(benchmark, item_text_col, block_bytes):
        there = shared_shingles(benchmark, item_text_col)
        rest, docs = parted(docs, text_col, there, False), stage(parted(docs, text_col, there, True))
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        docs = docs.mapInArrow(clean_filter(block, least, at), schema)
    return docs if rest is None else rest.unionByName(docs)


def clean_filter(block: Benchmark, least: float, column: int):
    def run(batches):
        hasher, table = Hasher(), byte_table(True)
        for batch in slices(batches):
            keep = np.ones(batch.num_rows, bool)
            for lo, words, h in word_hashes(batch.column(column), hasher, table):
                for i in block.sharing(words, h):
                    keep[lo + i] = not block.matches(h[words.first[i] : words.first[i + 1]], least)
            yield batch.filter(pa.array(keep))

    return run

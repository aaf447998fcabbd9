"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints within an even radius r meet in a value within r/2 of both.
So every distinct fingerprint emits all values within r/2 of it; those that
emitted a common value are within r of each other, hence the members of one
value need only be linked to their smallest: no pairs of a group are made.

Documents that share 0.8 of their five-word shingles differ in ten bits of 64,
whose balls are too large to emit. drop_near_copies() cuts the fingerprint into
slices, which differ in two bits at most in three pairs of four, and emits the
ball of each slice beside the least shingle in an order of the slice's: what
shares neither shingle nor slice doesn't meet, however common a passage is.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .chaining import classes_of, row_hashes, tokens_of
from .cluster import connected_components, drop, in_bitmap, key_bitmap, mapped, release, stage
from .decontaminate import features, weighted_similarity, word_hashes
from .textkit import Hasher, byte_table, majority, mix, shingles, within


def shingle_hashes(text: bytes, k: int, seed: int) -> list[int]:
    """XXH64 of each k-word shingle of a lower-cased text; of the whole sequence if it has fewer words; of nothing if it has none."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxh64_intdigest(joined, seed)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends[: len(words) - k])]
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins, ends[k - 1 :], strict=True)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text, as a signed long. Null and wordless texts have fingerprint 0."""

    def make():
        def run(batch: pa.RecordBatch):
            hashes, first = [], [0]
            out = []

            def close():
                if len(first) > 1:
                    out.append(majority(np.array(hashes, np.uint64), np.array(first)))
                hashes.clear()
                first[:] = [0]

            for text in batch.column(1).cast(pa.large_binary()):
                raw = text.as_py()
                hashes.extend(shingle_hashes(raw, k, seed) if raw else ())
                first.append(len(hashes))
                if len(hashes) > 1 << 17:
                    close()
            close()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64))], ["doc_id", "fp"])

        return run

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """All 64-bit masks of at most `radius` bits, as signed longs."""
    masks = [sum(1 << b for b in at) for n in range(radius + 1) for at in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp` that connect exactly those joined by steps of at most `radius` bits. radius: even."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it is emitted by either side")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    met = distinct.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
    low = met.withColumn("low", F.min("fp").over(Window.partitionBy("at"))).filter("fp <> low")
    return low.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= radius).select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows are repeated in
    the result; other columns are ignored, whatever their names. An empty table gives an empty result."""
    fps = stage(fingerprints(docs, id_col, text_col, k, seed))
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius))
    # both sides are staged, so that a component with most of the fingerprints is a join that can be split
    named = stage(distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = stage(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of = stage(named.join(least, "root").select("fp", "component_id"))
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A fingerprint of near copies has SLICES of SLICE_BITS; the copies of a document have words in shingles of SHINGLE.
SLICES, SLICE_BITS, SHINGLE = 5, 12, 5
ORDERS = mix(np.arange(101, 101 + SLICES, dtype=np.uint64)) | np.uint64(1)
NEAR = np.array([0, *(1 << b for b in range(SLICE_BITS))], np.uint64)


def shingle_sets(h: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row, of all its words if they are fewer, and where each row's begin, with the end."""
    n = np.diff(words.first)
    f, row = shingles(h, SHINGLE)[within(words.row, SHINGLE)], words.row[: max(0, len(h) - SHINGLE + 1)][within(words.row, SHINGLE)]
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    f, row = np.concatenate([f, row_hashes(h, words.first)[few]]), np.concatenate([row, few])
    order = np.argsort(row, kind="stable")
    return f[order], np.searchsorted(row[order], np.arange(len(n) + 1))


def sketches(texts: DataFrame) -> DataFrame:
    """(doc_id, th, keys) of every row of (doc_id, text): its class of equal words, and of each slice the keys that its ball meets others under.

    A key is of the least shingle in the slice's order, which two texts share as often as they are similar, and of
    the slice of the fingerprint, with at most one bit changed: slices of at most two differing bits have a common one."""

    def make():
        hasher, table = Hasher(), byte_table(True)

        def run(batch):
            out = []
            for _, words, h in word_hashes(batch.column(1), hasher, table):
                f, first = shingle_sets(h, words)
                some, prints = np.flatnonzero(np.diff(first)), majority(mix(f), first)
                keys = np.zeros((len(first) - 1, SLICES, len(NEAR)), np.uint64)
                for t, order in enumerate(ORDERS if len(some) else ()):
                    least = mix(np.minimum.reduceat(f * order, first[:-1][some]) + np.uint64(t))
                    part = prints[some] >> np.uint64(SLICE_BITS * t) & np.uint64((1 << SLICE_BITS) - 1)
                    keys[some, t] = mix(least[:, None] ^ (part[:, None] ^ NEAR))
                out.append((row_hashes(h, words.first).view(np.int64), keys.reshape(len(keys), -1).view(np.int64)))
            th, keys = (np.concatenate(c) for c in zip(*out, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(th), lists], ["doc_id", "th", "keys"])

        return run

    return mapped(texts, make, "doc_id long, th long, keys array<long>")


def similar_links(texts: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) between classes of equal words that meet under a key and have a weighted similarity of shingles of `least` or more. classes: (th, keys), staged.

    Of the classes under a key, all are compared with those of smallest and of largest hash: two stars, no pairs."""
    met = classes.filter("th <> 0").select("th", F.explode("keys").alias("at"))
    ends = stage(met.groupBy("at").agg(F.min("th").alias("low"), F.max("th").alias("high")).filter("low <> high"))
    there = key_bitmap(ends, "at")

    def make():
        def run(batch):
            keys = batch.column(1).flatten()
            keep = in_bitmap(there, keys.to_numpy())
            th = batch.column(0).take(pc.list_parent_indices(batch.column(1)))
            return pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in (th, keys)], ["th", "at"])

        return run

    again = mapped(classes.filter("th <> 0").select("th", "keys"), make, "th long, at long").join(ends, "at")
    pairs = again.select("th", F.explode(F.array("low", "high")).alias("rth")).filter("th <> rth")
    release(texts.sparkSession)
    pairs = stage(pairs.select(F.greatest("th", "rth").alias("u"), F.least("th", "rth").alias("v")).distinct())
    involved = key_bitmap(pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct(), "u")
    tokens = stage(tokens_of(texts, involved).groupBy("th").agg(F.first("tokens").alias("tokens")))
    both = pairs.join(tokens.withColumnRenamed("th", "u"), "u").withColumnRenamed("tokens", "a").join(tokens.withColumnRenamed("th", "v"), "v")

    def check():
        def run(batch):
            same = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(t.as_py(), "<u4").astype(np.uint64) for t in (a, b))
                same.append(weighted_similarity(features(x, SHINGLE), features(y, SHINGLE)) >= least)
            return batch.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

        return run

    return mapped(both.select("u", "v", F.col("a"), F.col("tokens").alias("b")), check, "u long, v long")


def near_copies(texts: DataFrame, least: float = 0.8) -> DataFrame:
    """(th, root, component_id, n_links) of every class of equal words of (doc_id, text): its group of near copies, the least id in the group, null if it has none, and how many classes it is linked to. Staged."""
    sketched = stage(sketches(texts))
    classes = stage(sketched.groupBy("th").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys")))
    links = stage(similar_links(texts, classes.select("th", "keys"), least))
    roots = connected_components(links)
    named = stage(classes.select("th", "least").join(roots.select(F.col("node").alias("th"), "root"), "th", "left").select("th", "least", F.coalesce("root", "th").alias("root")))
    # both sides are staged, so that a group with most of the classes is a join that can be split
    lowest = stage(named.groupBy("root").agg(F.min("least").alias("component_id")))
    degree = links.select("u").unionByName(links.select(F.col("v").alias("u"))).groupBy(F.col("u").alias("th")).agg(F.count("*").alias("n_links"))
    out = stage(named.join(lowest, "root").join(degree, "th", "left").select("th", "root", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    for table in (sketched, classes, links, named, lowest):
        drop(table)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """docs with one document, the one of smallest id, of each group of near copies.

    Near copies have equal words, lower-cased, of letters and digits, or share `least` of their five-word shingles, with
    repeats, or are joined by such steps. Candidates are found by balls around slices of SimHashes: pairs of similarity
    0.8 with probability 0.98, of 0.9 nearly always. Rows that share an id are one document: they stay or go together. A row without an id is a
    document of its own: it goes if it is a copy of one with an id; of copies without ids one row stays, that of the
    smallest hash. Null, empty and wordless texts are copies of each other. Texts of any length are read whole; columns
    of any name are kept; an empty table gives an empty result."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = near_copies(texts, least)
    keep = groups.filter("component_id is not null").select(F.col("component_id").alias(id_col)).distinct()
    nameless = docs.filter(F.col(id_col).cast("long").isNull()).withColumn("_row", F.xxhash64(F.col(text_col).cast("string")))
    rows = classes_of(nameless.select(F.col("_row").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    stays = rows.join(groups.filter("component_id is null"), "th").groupBy("root").agg(F.min("doc_id").alias("_row")).select("_row")
    row = F.struct(*docs.columns)
    one = nameless.join(stays, "_row", "left_semi").groupBy("_row").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return docs.join(keep, id_col, "left_semi").select(*docs.columns).unionByName(one)

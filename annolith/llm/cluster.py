"""Shared distributed building blocks of the corpus operators: staged tables, key bitmaps, connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEFT: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one is made only where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="annolith-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and return what was written: the lineage is cut, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/annolith-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _LEFT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._annolith_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that stage() wrote and no one reads any more."""
    path = getattr(df, "_annolith_path", None)
    if path and _LEFT.pop(path, None) is not None:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark deletes the shuffle files of jobs that are over. It does so by itself only when the driver's memory runs short, long after the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_LEFT.items()):
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def slices(batches, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `most` bytes (or one row), so that what a worker makes of one stays small however long the texts."""
    for batch in batches:
        n = batch.num_rows
        if n:
            step = max(1, int(n * most / max(1, batch.nbytes)))
            for lo in range(0, n, step):
                yield batch.slice(lo, step)


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Run a function over Arrow batches; make() runs once in each task and returns it."""

    def run(batches):
        f = make()
        for batch in slices(batches):
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    return df.mapInArrow(run, schema)


#: Bits of a key bitmap: about eight a key, at least 128 KiB and at most 32 MiB, beyond which it lets more pass.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def key_bitmap(df: DataFrame, column: str) -> bytes:
    """A Bloom filter with one hash, the low bits of a long column. It has more bits for more keys, up to MOST_BITS; pieces of 4 kB of it reach the driver. df is counted first: a staged table."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * df.count()).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(size - 1)) + 1
    pieces = df.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("m"))
    out = bytearray(size // 8)
    for b, m in pieces.toLocalIterator():
        out[(b - 1) * 4096 : b * 4096] = m
    return bytes(out)


def in_bitmap(bitmap: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the table that the bitmap was made of; none that is in it is missed."""
    at = keys.astype(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return (np.frombuffer(bitmap, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours. Staged, as is the table of the least, so that the join can be split where a hub has most of the edges."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    out = stage(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    drop(least)
    return out


def small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. e has the larger node as u."""
    least = stage(e.groupBy("u").agg(F.min("v").alias("m")))
    linked = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stage(linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    drop(least)
    return out


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v), root being the smallest node of its component.

    Large-star and small-star rounds (Kiveris et al., 2014) until the edges are stars on the roots; the rounds grow
    with the logarithm of the size.  Every round is staged, and only two numbers of it reach the driver."""
    e = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = mark(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        wide = large_star(e)
        drop(e)
        e = small_star(wide)
        drop(wide)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def sorted_runs(batches, keys: list[str]):
    """Batches sorted by keys, regrouped so that rows with equal keys come together: yields pyarrow tables of one key each. For groups of bounded size."""
    held: list[pa.RecordBatch] = []

    def same(a, i, b, j):
        return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            c = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        change[0] = bool(held) and not same(held[-1], held[-1].num_rows - 1, batch, 0)
        at = 0
        for cut in np.flatnonzero(change):
            if cut > at:
                held.append(batch.slice(at, int(cut) - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], int(cut)
        if n > at:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches, keys: list[str]):
    """Batches sorted by keys as tables that don't cut a run of equal keys: many short runs come together, a long one alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        other = np.zeros(n, bool)
        for k in keys:
            c = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            other |= c != c[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        ends = cut or (held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys))
        if ends:
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()

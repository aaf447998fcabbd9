"""Checks as tables: every check runs, its result is a row, and a failing one can hold back a write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ledger:
    """Collects checks (scope, check, ok, detail) and refuses to release a table while any fails."""

    def __init__(self):
        self.parts: list[DataFrame] = []

    def add(self, scope: str, name: str, df: DataFrame, ok: Column, detail: Column | None = None) -> Ledger:
        """A check over all rows of df: it holds if ok is true of every one. detail: an aggregate to report."""
        bad = F.sum((~F.coalesce(ok, F.lit(False))).cast("long"))
        said = F.coalesce(detail.cast("string"), F.lit("")) if detail is not None else F.lit("")
        row = df.agg(F.coalesce(bad, F.lit(0)).alias("bad"), said.alias("detail"))
        self.parts.append(row.select(F.lit(scope).alias("scope"), F.lit(name).alias("check"), (F.col("bad") == 0).alias("ok"), F.col("bad").alias("n_bad"), "detail"))
        return self

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def release(self, df: DataFrame) -> DataFrame:
        """df, if every check holds; else an error that names those that don't."""
        failed = self.table().filter("not ok").select("scope", "check", "n_bad").collect()
        if failed:
            raise ValueError("checks failed: " + ", ".join(f"{r.scope}/{r.check} ({r.n_bad} rows)" for r in failed))
        return df


def cardinality(df: DataFrame, by: str, key: str, expected: int, value: str) -> DataFrame:
    """Of each group: whether it has the expected number of rows, distinct keys, and finite values."""
    x = F.col(value)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.groupBy(by).agg((F.count("*") == expected).alias("complete"), (F.countDistinct(key) == F.count("*")).alias("unique"), F.min(finite).alias("finite"))


def missing_cells(actual: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells of the grid of rows by columns, both short lists of names, that actual hasn't."""
    return rows.crossJoin(columns).join(actual, [*rows.columns, *columns.columns], "left_anti")


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full_outer").filter("_a is null or _b is null").select(key, F.when(F.col("_b").isNull(), "first").otherwise("second").alias("only_in"))


def differences(a: DataFrame, b: DataFrame, key: str, values: list[str], tolerance: float) -> DataFrame:
    """(column, n, n_off, max_diff) over the keys that both have."""
    j = a.select(key, *[F.col(v).alias(f"a_{v}") for v in values]).join(b.select(key, *[F.col(v).alias(f"b_{v}") for v in values]), key)
    diff = F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")).alias("d")) for v in values]))
    rows = j.select(diff.alias("x")).select("x.column", "x.d")
    return rows.groupBy("column").agg(F.count("*").alias("n"), F.sum((F.coalesce(F.col("d"), F.lit(float("inf"))) > tolerance).cast("long")).alias("n_off"), F.max("d").alias("max_diff"))


def guard_shrink(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """new, unless it has fewer rows than old; forced, in any case."""
    if not force:
        n, was = new.count(), old.count()
        if n < was:
            raise ValueError(f"{n} rows would replace {was}; force it if that is meant")
    return new


def equal_rows(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of which some column differs, nulls being equal, with the names of those columns."""
    names = [c for c in a.columns if c != key]
    j = a.alias("a").join(b.alias("b"), key)
    off = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return j.select(key, off.alias("differs")).filter(F.size("differs") > 0)


def leaked_items(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "item_id", item_text: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """(key) of the items that stand word for word in some document.

    The items are a stated set of queries against all documents: they are sent to the executors in blocks of a checked
    size, one after the other, and only keys come back."""
    rows = items.select(key, F.col(item_text).alias("_item")).filter("_item is not null")
    size = rows.agg(F.sum(F.octet_length("_item")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = [rows.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) for b in range(blocks)]
    found = [docs.select(F.col(text).alias("_doc")).join(F.broadcast(p), F.contains("_doc", "_item")).select(key).distinct() for p in parts]
    return reduce(DataFrame.unionByName, found)

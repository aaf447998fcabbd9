"""The driver contract: every query of the reference's operators against its DuckDB twin, on the smallest tables."""

import glob
import math
import os

import pytest

from annolith.plans import registry

NAMES = sorted(registry.queries())


def plain(x):
    if x is None or x is getattr(__import__("pandas"), "NaT", None) or type(x).__name__ == "NAType":
        return "null"
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return "null" if math.isnan(x) else f"{float(x):.9g}"
    if type(x).__name__ in ("bool", "bool_", "Decimal"):
        return str(x) if type(x).__name__ != "Decimal" else f"{float(x):.9g}"
    if isinstance(x, int) or type(x).__name__.startswith(("int", "uint")):
        return f"{float(x):.9g}"
    if isinstance(x, list | tuple) or type(x).__name__ == "ndarray":
        return str([plain(y) for y in x])
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["step", "n_chunks", "n_kept", "n_leaked", "total_excluded"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

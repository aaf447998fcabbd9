"""Named queries over the driver's tables, each with a DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame under a name, with the SQL of its twin."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog  # noqa: F401  registers all

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    from . import catalog  # noqa: F401

    return _ORACLES

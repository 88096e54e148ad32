"""Every query of the library by name, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir)."""

    def add(f):
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def oracle_of(name: str) -> str:
    """The SQL of a query that is registered already, for another order of the same rows."""
    return _sql[name]


def _load() -> None:
    from reelframe.plans import library, releases, streams, subtitles, timeline, titles  # noqa: F401, I001
    from reelframe.plans import details  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _sql

"""Registry of checked queries: name -> (Spark callable, oracle SQL or None).

Each callable takes (spark, sf_dir) and returns a DataFrame over the driver
tables; the SQL, when given, computes the same rows in DuckDB with the same
column names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise KeyError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from tessera.plans import queries_checks, queries_core, queries_loads, queries_more, queries_ops, queries_ops2, queries_text  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)

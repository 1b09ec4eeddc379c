"""Names of the reference operators' queries and their SQL twins.

Modules of this package register with ``query``; importing them is enough.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("relational", "aggregates", "graphs", "asking", "extraction", "snapshots", "quality", "budget", "events", "files", "testing", "modernization", "compress")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that DuckDB answers alike."""

    def put(f: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"loomwork.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

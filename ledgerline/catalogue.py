"""The registered queries of the entity engine, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``; ``oracle`` is its DuckDB SQL, if SQL can state it."""

    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if oracle is not None:
            _ORACLES[name] = oracle
        return query

    return add


def _load() -> None:
    import ledgerline.plans.driver_queries  # noqa: F401  registers its queries
    import ledgerline.plans.table_model  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)

"""Named queries of the core: name -> (DataFrame builder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES: tuple[str, ...] = ("graph_queries", "traversal_queries", "outcome_queries", "construct_queries", "text_queries", "governance_queries", "score_queries", "source_queries")


def query(sql: str | None = None):
    """Register a function of ``(spark, sf_dir)`` under its name, with the SQL that must give the same rows."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def _load() -> None:
    import importlib

    for m in _MODULES:
        importlib.import_module(f"loomgraph.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

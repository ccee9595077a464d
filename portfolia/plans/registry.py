"""All queries over the test tables, and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from portfolia.sources.bindings import SQL, Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function of ``Tables`` by its name; ``sql`` follows the common table expressions of the domain."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = f"WITH RECURSIVE {SQL.strip()}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return keep


def _load() -> None:
    from portfolia.operators import audit, catalog, constraints, editor, imports, integrity, planning, portfolio, provenance, quality, reconciled, rules, views, writes  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

"""Registry of the driver queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from importlib import import_module

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name` with the SQL that DuckDB can run for it."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


#: Modules that register queries.
MODULES = ("batch_queries", "scalar_queries", "grid_queries", "network_queries", "geometry_queries", "source_queries", "feature_queries", "frame_queries", "field_queries", "line_queries", "junction_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"geoloom.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

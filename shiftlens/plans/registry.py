"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from shiftlens.plans.views import Views, with_views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the views, with the SQL that must give the same rows."""

    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register

"""Registration of queries with their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from recordloom.plans.views import Source, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, *views: str) -> Callable:
    """Register ``f(source)`` under its name."""

    def put(f):
        def run(spark, sf_dir):
            return f(Source(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql, *views)
        return f

    return put

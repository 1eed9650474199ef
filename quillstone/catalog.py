"""Registered queries of the library: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds f(spark, sf_dir) under `name`, with its oracle where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from .plans import corpus_queries, curation_queries, lifecycle_queries, ranking_queries, relational_queries, scan_queries, search_queries, service_queries  # noqa: E402, F401  registers on import

"""Registered queries over the given tables, each with an independent SQL twin."""

from __future__ import annotations

from importlib import import_module

from findery.workload.registry import QUERIES, SQL, Build

_MODULES = (
    "analytics_queries", "extract_queries", "match_queries", "rank_queries", "facet_queries",
    "describe_queries", "reply_queries", "search_queries", "composed_queries", "stream_queries", "source_queries",
)


def _load() -> None:
    for module in _MODULES:
        import_module(f"findery.workload.{module}")


def all_queries() -> dict[str, Build]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)

"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations


def _modules() -> list:
    from . import corpus, entities, linkage, orphan_links, series

    return [series, entities, linkage, corpus, orphan_links]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}

"""All queries of the core library and their SQL counterparts."""

from __future__ import annotations

from tamarack.plans import easy, engine_queries, enterprise, hard, harness_queries, hierarchy_queries, medium, very_hard

_MODULES = [hierarchy_queries, harness_queries, engine_queries]
_TEMPLATES = [easy, medium, hard, very_hard, enterprise]


def templates() -> dict:
    """Every template by name."""
    return {t.name: t for m in _TEMPLATES for t in m.TEMPLATES}


def queries() -> dict:
    found = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
    return found | {name: t.query for name, t in templates().items()}


def oracle_sql() -> dict:
    found = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
    return found | {name: t.oracle() for name, t in templates().items()}

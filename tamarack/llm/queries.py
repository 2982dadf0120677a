"""All queries over training data and their SQL counterparts."""

from __future__ import annotations

from tamarack.llm import corpus_queries, record_queries

_MODULES = [record_queries, corpus_queries]


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}

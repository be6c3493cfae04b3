"""Queries of the engine's operators."""

from __future__ import annotations

from . import evaluation_queries, report_queries, text_queries

_MODULES = (text_queries, report_queries, evaluation_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}

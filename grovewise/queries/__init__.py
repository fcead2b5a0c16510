"""All queries of the core and their SQL."""

from __future__ import annotations

from grovewise.queries import expressions, files, problems, relations

MODULES = (expressions, relations, files, problems)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

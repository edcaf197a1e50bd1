"""One registered query per operator over the star-schema tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from . import graph, incremental, pages, relational, scalars, vectors

MODULES = (scalars, relational, graph, vectors, pages, incremental)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}

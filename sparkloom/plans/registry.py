"""Registry of the queries and of their SQL."""

from __future__ import annotations

from . import article_queries, daily_queries, market_queries, source_queries

MODULES = (article_queries, daily_queries, market_queries, source_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}

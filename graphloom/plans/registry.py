"""All queries of the graph engine by name, and their SQL."""

from __future__ import annotations

from . import graph_queries, store_queries, text_queries


def queries() -> dict:
    return graph_queries.QUERIES | text_queries.QUERIES | store_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return graph_queries.ORACLES | text_queries.ORACLES | store_queries.ORACLES

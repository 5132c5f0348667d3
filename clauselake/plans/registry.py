"""All runnable queries and their oracle statements."""

from __future__ import annotations

from clauselake.plans import calc_queries, memory_queries, review_queries, search_queries, sql_queries, table_queries

_MODULES = [calc_queries, search_queries, review_queries, memory_queries, table_queries, sql_queries]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in _MODULES for name, q in m.ORACLES.items()}

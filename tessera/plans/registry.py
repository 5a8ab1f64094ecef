"""All registered queries of the library and their oracles."""

from __future__ import annotations

from tessera.plans import oracles, queries, source_queries, syntax_queries

QUERIES = queries.QUERIES | syntax_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | syntax_queries.ORACLE_SQL | source_queries.ORACLE_SQL

"""All queries over the engine's own operators, and their SQL."""

from __future__ import annotations

from meritgrid.plans import feature_queries, identity_queries, monitoring_queries, record_queries, routing_queries, rule_queries, store_queries

_PARTS = (feature_queries, identity_queries, monitoring_queries, record_queries, routing_queries, rule_queries, store_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}

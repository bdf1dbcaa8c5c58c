"""All queries of the library and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from skerry.plans import admin_queries, operator_queries, relational_queries, text_queries
from skerry.streaming import queries as streaming_queries

MODULES = [text_queries, relational_queries, operator_queries, admin_queries, streaming_queries]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}

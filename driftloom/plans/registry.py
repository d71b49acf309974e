"""Registered queries by name, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import run_queries, sketch_queries, trace_queries, vector_queries

QUERIES = vector_queries.QUERIES | sketch_queries.QUERIES | trace_queries.QUERIES | run_queries.QUERIES
ORACLE_SQL = vector_queries.ORACLE_SQL | sketch_queries.ORACLE_SQL | trace_queries.ORACLE_SQL | run_queries.ORACLE_SQL

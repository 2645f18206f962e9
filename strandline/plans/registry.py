"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from strandline.plans import array_queries, model_queries, more_queries, search_queries, series_queries, source_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (search_queries, series_queries, array_queries, more_queries, model_queries, source_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL

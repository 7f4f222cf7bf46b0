"""All registered queries of the pattern operators, with their SQL where SQL can state them."""

from __future__ import annotations

from . import cleaning_queries, grid_queries, metric_queries, model_queries

QUERIES, ORACLE_SQL = {}, {}
for _module in (cleaning_queries, grid_queries, metric_queries, model_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL

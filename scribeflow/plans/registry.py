"""All registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from scribeflow.plans import batch_queries, function_queries, search_queries, write_queries

QUERIES = search_queries.QUERIES | batch_queries.QUERIES | write_queries.QUERIES | function_queries.QUERIES
SQL = search_queries.SQL | batch_queries.SQL | write_queries.SQL | function_queries.SQL

"""All queries over the test tables, and their SQL."""

from __future__ import annotations

from . import image_queries, queries

QUERIES = queries.QUERIES | image_queries.QUERIES
SQL = queries.SQL | image_queries.SQL

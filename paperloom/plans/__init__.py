"""Registered queries and their SQL."""

from . import layout_queries, media_queries, schema_queries, source_queries, store_queries, summary_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "layout_queries", "media_queries", "schema_queries", "source_queries", "store_queries", "summary_queries", "text_queries"]

"""All registered queries of the related-table engine, and their SQL twins."""

from __future__ import annotations

from tidewater.plans import relate_queries, search_queries, store_queries
from tidewater.plans.queries import ORACLE, QUERIES

MODULES = (relate_queries, search_queries, store_queries)
__all__ = ["MODULES", "ORACLE", "QUERIES"]

"""All registered queries."""

from tidemark.plans import agg_queries, flagship, join_queries, model_queries, row_queries, source_queries, time_queries  # noqa: F401
from tidemark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

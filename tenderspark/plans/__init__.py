"""Registered queries and the SQL that states their results."""

from . import indexed_queries, landed_queries, profile_queries, risk_queries, search_queries, source_queries, spend_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""Queries and their SQL, by name."""

from . import law_queries, mesh_queries, solve_queries  # noqa: F401  (they add their queries)
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

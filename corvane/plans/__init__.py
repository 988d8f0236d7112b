"""Registered queries and their SQL twins."""

from corvane.plans import golden, runs
from corvane.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "golden", "runs"]

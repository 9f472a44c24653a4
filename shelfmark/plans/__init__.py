"""Whole plans built from the operators, and the queries that are verified."""

from shelfmark.plans import feed_queries, read_queries, scalar_queries, write_queries  # noqa: F401  (they register themselves)
from shelfmark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

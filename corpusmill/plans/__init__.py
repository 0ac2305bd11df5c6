"""Registered queries."""

from corpusmill.plans import catalogue, gate_queries, source_queries, suite_queries, token_queries
from corpusmill.plans.entries import ENTRIES

__all__ = ["ENTRIES", "catalogue", "gate_queries", "source_queries", "suite_queries", "token_queries"]

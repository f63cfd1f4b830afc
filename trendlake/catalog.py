"""Every registered query, with its SQL where SQL can express it."""

from .plans import oracles, queries, source_queries, state_queries

QUERIES = queries.QUERIES | source_queries.QUERIES | state_queries.QUERIES
ORACLES = oracles.ORACLES | source_queries.ORACLES | state_queries.ORACLES

__all__ = ["ORACLES", "QUERIES"]

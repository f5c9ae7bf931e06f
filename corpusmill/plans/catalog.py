"""Every registered query of the core library, with its oracle SQL."""

from corpusmill.plans import document_queries, evaluation_queries, further_queries, more_queries, operation_queries, request_queries, retrieval_queries  # noqa: F401
from corpusmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

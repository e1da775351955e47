"""Registered queries of the library's own operators and their SQL."""

from kadastra.plans import detail_queries, evaluation_queries, graph_queries, retrieval_queries, source_queries, survey_queries, text_queries, truth_queries  # noqa: F401
from kadastra.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""All queries of the engine, gathered from their modules."""

from turnloom.plans import io_queries, planning_queries, score_queries, transcript_queries
from turnloom.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "io_queries", "planning_queries", "score_queries", "transcript_queries"]

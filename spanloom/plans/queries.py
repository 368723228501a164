"""All queries of this library."""

from spanloom.plans import graph_queries, job_queries, ladder_queries, log_queries, profile_queries, run_queries, text_queries  # noqa: F401
from spanloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""All registered queries."""

from dueline.plans import case_queries, event_queries, model_queries, report_queries
from dueline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "case_queries", "event_queries", "model_queries", "report_queries"]

"""Registered queries and the SQL that checks them."""

from rillflow.plans import flow_queries, header_queries, lookup_queries, report_queries, stream_queries
from rillflow.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flow_queries", "header_queries", "lookup_queries", "report_queries", "stream_queries"]

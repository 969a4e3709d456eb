"""Imports every module that registers queries."""

from . import fact_queries, job_queries, listing_queries, page_queries, policy_queries, relational_queries, url_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

"""All registered queries and oracles of the storage-analytics operators."""

from lakeglass.plans import more_queries, plan_queries, store_queries  # noqa: F401  they register their queries
from lakeglass.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

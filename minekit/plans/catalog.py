"""All registered queries, collected by importing the modules that define them."""

from minekit.plans import (
    classify_queries,
    cluster_queries,
    profile_queries,
    relation_queries,
    study_queries,
    table_queries,
)
from minekit.plans.registry import ORACLES, QUERIES

flagship = study_queries.flagship

__all__ = [
    "ORACLES", "QUERIES", "classify_queries", "cluster_queries", "flagship", "profile_queries", "relation_queries",
    "study_queries", "table_queries",
]

"""All registered queries."""

from notemill.plans import corpus_queries, evaluation_queries, file_queries, link_queries, ml_queries, model_queries, neighbour_queries  # noqa: F401
from notemill.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

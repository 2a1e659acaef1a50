"""Importing this module registers every query."""

from rankloom.plans import (  # noqa: F401
    behaviour_queries,
    embedding_queries,
    feature_queries,
    io_queries,
    metric_queries,
    sample_queries,
    streaming_queries,
    training_queries,
)
from rankloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

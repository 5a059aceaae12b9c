"""Registered queries: each operator on the test tables, and its SQL."""

from . import dataset_queries, evaluation_queries, history_queries, live_queries, model_queries, source_queries, trip_queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "dataset_queries", "evaluation_queries", "history_queries", "live_queries", "model_queries", "source_queries", "trip_queries"]

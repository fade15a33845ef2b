"""All queries of the library."""

from . import function_queries, model_queries, source_queries, table_queries, text_queries, vector_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "function_queries", "model_queries", "source_queries", "table_queries", "text_queries", "vector_queries"]

"""All registered queries."""

from . import board_queries, extract_queries, lifecycle_queries, quality_queries, rule_queries, source_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Queries over the driver's tables, one per operator group."""

from lotwise.queries import (  # noqa: F401
    file_queries,
    model_queries,
    place_queries,
    profile_queries,
    source_queries,
    stat_queries,
    text_queries,
)
from lotwise.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Named queries over the test tables, each with the SQL that gives the same rows."""

from flowloom.catalog import (  # noqa: F401
    dataset_queries,
    feature_queries,
    packet_queries,
    score_queries,
    source_queries,
)
from flowloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

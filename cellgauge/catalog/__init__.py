"""Registered queries over the driver tables and their SQL twins."""

from cellgauge.catalog import data_queries, model_queries, score_queries  # noqa: F401
from cellgauge.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

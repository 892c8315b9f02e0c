"""Runnable queries over the sample tables; importing this package fills the catalog."""

from . import (  # noqa: F401
    card_queries, key_queries, matrix_queries, metric_queries, report_queries, source_queries,
)
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

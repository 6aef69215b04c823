"""All ready-made queries; importing the modules registers them."""

from __future__ import annotations

from . import bronze_queries, cdc_queries, check_queries, gold_queries, run_queries, search_queries, silver_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

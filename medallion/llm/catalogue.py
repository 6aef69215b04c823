"""All queries of the subpackage and their SQL."""

from . import record_queries  # noqa: F401  registers its queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

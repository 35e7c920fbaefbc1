"""All registered queries."""

from . import curated, reports, stories, surfaces  # noqa: F401  they register their queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

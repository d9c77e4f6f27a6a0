"""All registered queries over the driver's tables, and the SQL each must equal."""

from __future__ import annotations

# the modules register their queries when they are imported
from . import effect_queries, figure_queries, log_queries, match_queries, pool_queries, reading_queries, record_queries, resolve_queries, sensitivity_queries, text_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

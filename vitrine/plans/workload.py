"""All registered queries."""
from __future__ import annotations

from vitrine.plans import browse_queries, extract_queries, merge_queries, record_queries, text_queries  # noqa: F401
from vitrine.plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

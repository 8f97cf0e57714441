"""All registered queries.  Importing this module registers them."""

from __future__ import annotations

from spanloom.plans import build_queries, consensus_queries, edit_queries, extract_queries, legacy_queries, propagate_queries, record_queries, run_queries, source_queries, text_queries  # noqa: F401
from spanloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

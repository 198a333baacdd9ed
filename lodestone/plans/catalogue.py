"""All queries of the catalogue: importing the modules registers them."""

from __future__ import annotations

from lodestone.plans import discovery_queries, graph_queries, member_queries, ml_queries, pattern_queries, profile_queries, relation_queries, score_queries, source_queries, text_queries, version_queries  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""The registered queries of the series operators."""

from __future__ import annotations

from serion.plans import series_queries, zero_queries
from serion.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]

flagship = zero_queries.zeros_and_events

assert series_queries.event_gaps.__name__ in QUERIES

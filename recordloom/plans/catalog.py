"""All registered queries of the record engine, with their DuckDB equivalents."""

from __future__ import annotations

from recordloom.plans import array_queries, delta_queries, identity_queries, mapping_queries, resolve_queries, state_queries  # noqa: F401
from recordloom.plans.registry import ORACLE, QUERIES  # noqa: F401

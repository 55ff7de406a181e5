"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from fleetline.plans import metric_queries, rollup_queries, schedule_queries  # noqa: F401  registers its queries
from fleetline.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

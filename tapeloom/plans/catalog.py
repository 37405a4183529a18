"""All registered queries."""

from __future__ import annotations

from tapeloom.plans import (  # noqa: F401
    bar_queries,
    grid_queries,
    metric_queries,
    research_queries,
    trade_queries,
)
from tapeloom.plans.registry import QUERIES, SQL

FLAGSHIP = "g13_sector_metrics"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]

"""All registered queries."""

from __future__ import annotations

from sluice.plans import detect_queries, flow_queries, metric_queries, model_queries, source_queries, stream_queries, table_queries  # noqa: F401
from sluice.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

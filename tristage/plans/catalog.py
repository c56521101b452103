"""All registered queries."""

from __future__ import annotations

import importlib

from tristage.plans.registry import ORACLES, QUERIES

AREAS = (
    "label_queries", "text_queries", "quality_queries", "split_queries", "metric_queries",
    "stats_queries", "similarity_queries", "model_queries", "source_queries", "audit_queries",
)
for _area in AREAS:
    importlib.import_module(f"tristage.plans.{_area}")

__all__ = ["ORACLES", "QUERIES"]

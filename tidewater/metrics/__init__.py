"""Metric layer: metric views, semantic metrics, auto-derived explores."""

from tidewater.metrics.views import (
    MetricsView,
    Measure,
    SemanticModel,
    auto_metrics,
    classify_type,
    densify,
    measure_name,
)

__all__ = [
    "MetricsView",
    "Measure",
    "SemanticModel",
    "auto_metrics",
    "classify_type",
    "densify",
    "measure_name",
]

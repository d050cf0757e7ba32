"""All registered queries."""

from __future__ import annotations

from riskweave.plans import (  # noqa: F401
    context_queries,
    corpus_queries,
    detection_queries,
    evaluation_queries,
    generation_queries,
    label_queries,
    results_queries,
    source_queries,
    statistics_queries,
    stream_queries,
)
from riskweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

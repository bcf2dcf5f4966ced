"""Runnable queries, each beside the SQL that checks it."""

from vitalcells.registry.base import ORACLES, QUERIES
from vitalcells.registry import (  # noqa: F401  registration happens on import
    sources_q, normalise_q, cohort_q, joins_q, aggregates_q, reshape_q, models_q, reports_q,
    relevance_q,
)

__all__ = ["ORACLES", "QUERIES"]

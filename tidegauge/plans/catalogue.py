"""All registered queries."""

from __future__ import annotations

from tidegauge.plans import (  # noqa: F401
    comparison_queries,
    energy_queries,
    ingest_queries,
    pod_queries,
    rate_queries,
    scan_queries,
)
from tidegauge.plans.registry import ORACLES, QUERIES


def queries():
    """Name to ``fn(spark, folder)``."""
    return dict(QUERIES)


def oracle_sql():
    """Name to SQL text."""
    return dict(ORACLES)

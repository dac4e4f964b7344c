"""Scalar expressions over telemetry columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed


def clean_number(value: Column) -> Column:
    """NaN becomes NULL, so aggregates skip it."""
    return F.nanvl(value, F.lit(None).cast("double"))


def epoch_seconds(stamp: str) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.expr(
        f"CAST(unix_date(CAST({stamp} AS DATE)) AS BIGINT) * 86400 "
        f"+ hour({stamp}) * 3600 + minute({stamp}) * 60 + second({stamp})"
    ).cast("bigint")


def is_system_context(context: Column) -> Column:
    """Context belongs to one of the system families."""
    return context.rlike(fixed.SYSTEM_CONTEXT_PATTERN)


def is_worker_core(metric: Column) -> Column:
    """One of the four worker cores."""
    return metric.isin(fixed.WORKER_CORES)


def container_key(chart_id: Column) -> Column:
    """``{qos}_pod{uuid}`` of a container chart id, empty where it does not match.

    One pattern match serves both parts: the uuid holds no underscore, so the
    last ``_pod`` is where the class ends.
    """
    return F.regexp_extract(chart_id, fixed.CHART_ID_PATTERN, 1)


def pod_uuid(key: Column) -> Column:
    """Pod id (with its ``pod`` prefix) of a container key."""
    return F.concat(F.lit("pod"), F.substring_index(key, "_pod", -1))


def qos_class(key: Column) -> Column:
    """Quality-of-service class of a container key."""
    tail = F.length(F.substring_index(key, "_pod", -1)) + F.length(F.lit("_pod"))
    return F.substring(key, F.lit(1), F.length(key) - tail)


def pod_label(pod: Column) -> Column:
    """First eight characters of the pod id without its prefix."""
    return F.substring(F.replace(pod, F.lit("pod"), F.lit("")), 1, 8)


def keeps_dimension(dims: Column, name: Column) -> Column:
    """A NULL list keeps every dimension."""
    return dims.isNull() | F.array_contains(dims, name)

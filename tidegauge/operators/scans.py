"""Selections over telemetry.

They are plain filters and projections: on a partitioned table the run key
prunes folders, and context and host predicates reach the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions.telemetry import is_system_context, is_worker_core

RUN = ["kd", "test_type", "run"]
RENAMES = {"relative_time": "timestamp", "metric_id": "id", "metric_name": "name"}


def in_contexts(telemetry: DataFrame, contexts: Sequence[str]) -> DataFrame:
    """Keep rows of the given contexts."""
    return telemetry.where(F.col("chart_context").isin(list(contexts)))


def on_hosts(telemetry: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """Keep rows of the given hosts."""
    return telemetry.where(F.col("hostname").isin(list(hosts)))


def system_contexts(telemetry: DataFrame) -> DataFrame:
    """Keep rows whose context belongs to a system family."""
    return telemetry.where(is_system_context(F.col("chart_context")))


def worker_cores(telemetry: DataFrame) -> DataFrame:
    """Keep rows of the four worker cores."""
    return telemetry.where(is_worker_core(F.col("metric_id")))


def renamed(telemetry: DataFrame) -> DataFrame:
    """Short names for time, metric id and metric name."""
    return telemetry.withColumnsRenamed(RENAMES)


def run_rows(
    telemetry: DataFrame,
    kd: str | None = None,
    test_type: str | None = None,
    run: int | None = None,
    contexts: Sequence[str] | None = None,
    hosts: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of one run, or of all runs when the run is not given.

    A run without data yields no rows.
    """
    rows = telemetry
    for name, wanted in (("kd", kd), ("test_type", test_type), ("run", run)):
        if wanted is not None:
            rows = rows.where(F.col(name) == F.lit(wanted))
    if contexts:
        rows = in_contexts(rows, contexts)
    if hosts:
        rows = on_hosts(rows, hosts)
    return renamed(rows)


def container_rows(telemetry: DataFrame, **selection) -> DataFrame:
    """Rows of all container contexts."""
    only = telemetry.where(F.col("chart_context").startswith(fixed.CGROUP_PREFIX))
    return run_rows(only, **selection)


def container_order(rows: DataFrame) -> DataFrame:
    """Global order of container rows (range-partitioned by Spark)."""
    return rows.orderBy("timestamp", "hostname", "chart_context", "name")


def run_keys(by_context: bool = False) -> list[str]:
    """Sort keys of run files: run, then time first, or with ``by_context`` the context.

    Analyses select a few contexts of many, so row groups that hold one context let
    the reader skip the others.
    """
    keys = ["relative_time", "hostname", "chart_context", "metric_id"]
    if by_context:
        keys = ["chart_context", "relative_time", "hostname", "metric_id"]
    return [*RUN, *keys]


def run_order(telemetry: DataFrame, by_context: bool = False) -> DataFrame:
    """Order inside each partition, as run files are written."""
    return telemetry.sortWithinPartitions(*run_keys(by_context))


def sorted_runs(telemetry: DataFrame, by_context: bool = False) -> DataFrame:
    """Total order of all runs: partitions are disjoint ranges, one after the other.

    The range partitioner cuts inside a run by time, host, context and metric, so a run
    that holds a third of the rows is spread like any other rows.
    """
    return telemetry.orderBy(*run_keys(by_context))


def union_runs(*tables: DataFrame) -> DataFrame:
    """Concatenate tables by column name."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first

"""Silver layer: one value per run, host, container group and metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions import telemetry as cells
from tidegauge.operators.scans import RUN
from tidegauge.schemas import SILVER_COLUMNS


def parsed_containers(telemetry: DataFrame) -> DataFrame:
    """Container rows with pod id and class; ids that do not match are dropped."""
    return (
        telemetry.where(F.col("chart_context").startswith(fixed.CGROUP_PREFIX))
        .withColumn("_container", cells.container_key(F.col("chart_id")))
        .where(F.col("_container") != "")
        .withColumn("pod_uuid", cells.pod_uuid(F.col("_container")))
        .withColumn("qos_class", cells.qos_class(F.col("_container")))
        .drop("_container")
    )


def with_metric_definition(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Attach the metric definition; contexts without one are dropped.

    The definitions are a fixed table of nine rows, hence the broadcast.
    """
    return rows.join(F.broadcast(definitions), "chart_context")


def with_kept_dimensions(rows: DataFrame) -> DataFrame:
    """Keep the dimensions the definition lists (all if it lists none)."""
    return rows.where(cells.keeps_dimension(F.col("dims"), F.col("metric_name")))


def container_seconds(telemetry: DataFrame, definitions: DataFrame) -> DataFrame:
    """Sum and maximum per second, of a host's container and metric.

    The pattern runs once per kept row and its result is the grouping key ``_container``.
    Rows that do not match share one small group per second with an empty key; a filter
    on the key would be pushed to the scan and match again.
    """
    only = telemetry.where(F.col("chart_context").startswith(fixed.CGROUP_PREFIX))
    kept = with_kept_dimensions(with_metric_definition(only, definitions)).select(
        *RUN, "hostname", "metric", "relative_time", "value",
        cells.container_key(F.col("chart_id")).alias("_container"),
    )
    return kept.groupBy(*RUN, "hostname", "_container", "metric", "relative_time").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("_sum"), F.max("value").alias("_max")
    )


def silver_pod_metrics(telemetry: DataFrame, definitions: DataFrame) -> DataFrame:
    """Combine dimensions and containers per second, then average the seconds.

    Pod and class are cut out of the container key once per group; the group of rows
    that do not match is dropped by an aggregate flag.  Sum and maximum are both formed;
    the definition then says which counts.  Units and rule follow from the metric and
    are attached after the shuffle.
    """
    means = (
        container_seconds(telemetry, definitions)
        .groupBy(*RUN, "hostname", "_container", "metric")
        .agg(
            F.avg("_sum").alias("_mean_sum"),
            F.avg("_max").alias("_mean_max"),
            F.count("*").alias("n_samples"),
            F.max(F.col("_container") != "").alias("_matched"),
        )
        .where(F.col("_matched"))
    )
    rules = definitions.select("metric", F.col("metric_units").alias("units"), "dim_agg")
    container = F.col("_container")
    value = F.when(F.col("dim_agg") == "sum", F.col("_mean_sum")).otherwise(F.col("_mean_max"))
    return means.join(F.broadcast(rules), "metric").select(
        *RUN, "hostname",
        cells.pod_uuid(container).alias("pod_uuid"),
        cells.qos_class(container).alias("qos_class"),
        "metric", value.alias("value"), "units", "n_samples",
    )


def silver_table(telemetry: DataFrame, definitions: DataFrame) -> DataFrame:
    """All systems, tests and runs in one job, in the canonical column order."""
    return silver_pod_metrics(telemetry, definitions).select(*SILVER_COLUMNS)

"""Frequency, activity, power and energy.

The flow keeps shrinking: one scan and one partial aggregation give a row per
(kd, test, second, host); two more aggregations give seconds and then tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions.labels import fixed_text
from tidegauge.functions import power as model
from tidegauge.functions.telemetry import is_worker_core
from tidegauge.operators.scans import on_hosts

TEST = ["kd", "test_type"]
SEGMENT_SECONDS = 3600


def host_seconds(telemetry: DataFrame) -> DataFrame:
    """Mean worker frequency and mean idle reading per (kd, test, second, host).

    Runs are pooled on relative time.  Both means come from one pass: they
    share key and scan, so a conditional aggregate replaces the outer join.
    """
    frequency = (F.col("chart_context") == fixed.CTX_FREQ) & is_worker_core(F.col("metric_id"))
    idle = (F.col("chart_context") == fixed.CTX_CPU) & (F.col("metric_id") == "idle")
    return (
        on_hosts(telemetry, fixed.WORKERS)
        .where(frequency | idle)
        .groupBy(*TEST, "relative_time", "hostname")
        .agg(
            F.avg(F.when(frequency, F.col("value"))).alias("mean_freq_mhz"),
            F.avg(F.when(idle, F.col("value"))).alias("mean_idle"),
        )
    )


def with_activity(cells: DataFrame, full_scale: float = fixed.IDLE_FULL_SCALE) -> DataFrame:
    """Cells with a frequency, each with its busy share (default where unknown)."""
    return cells.where(F.col("mean_freq_mhz").isNotNull()).withColumn(
        "activity_ratio", model.activity(F.col("mean_idle"), full_scale)
    )


def with_power(cells: DataFrame) -> DataFrame:
    """Add the power estimate."""
    return cells.withColumn(
        "power_w", model.power(F.col("mean_freq_mhz"), F.col("activity_ratio"))
    )


def cluster_seconds(cells: DataFrame) -> DataFrame:
    """Mean power and frequency over the workers, per second."""
    return cells.groupBy(*TEST, "relative_time").agg(
        F.avg("power_w").alias("mean_power_w"), F.avg("mean_freq_mhz").alias("mean_freq_mhz")
    )


def series_summary(
    series: DataFrame,
    by: list[str],
    at: str,
    value: str,
    describe: list[str],
    segment: int = SEGMENT_SECONDS,
) -> DataFrame:
    """Trapezoid integral of ``value`` over ``at``, span, count, means and deviations.

    A long series of one key never lands in one task.  Areas and moments are
    formed inside fixed time segments; a second, tiny step per key adds the
    piece between the last point of a segment and the first of the next one,
    and merges the moments about the overall mean.
    """
    inside = Window.partitionBy(*by, "_segment").orderBy(at)
    gap = F.col(at) - F.lag(at).over(inside)
    height = (F.col(value) + F.lag(value).over(inside)) / 2
    moments = []
    for name in describe:
        moments.append(F.avg(name).alias(f"_mean_{name}"))
        moments.append((F.var_pop(name) * F.count(name)).alias(f"_square_{name}"))
    parts = (
        series.withColumn("_segment", F.floor(F.col(at) / segment))
        .withColumn("_area", gap * height)
        .groupBy(*by, "_segment")
        .agg(
            F.coalesce(F.sum("_area"), F.lit(0.0)).alias("_area"),
            F.min(at).alias("_from"),
            F.max(at).alias("_to"),
            F.min_by(value, at).alias("_first"),
            F.max_by(value, at).alias("_last"),
            F.count("*").alias("_n"),
            *moments,
        )
    )
    key = Window.partitionBy(*by)
    across = key.orderBy("_segment")
    bridge = (
        (F.col("_from") - F.lag("_to").over(across))
        * (F.col("_first") + F.lag("_last").over(across))
        / 2
    )
    merged = parts.withColumn("_bridge", F.coalesce(bridge, F.lit(0.0)))
    summary = []
    for name in describe:
        overall = F.sum(F.col("_n") * F.col(f"_mean_{name}")).over(key) / F.sum("_n").over(key)
        merged = merged.withColumn(f"_all_{name}", overall)
        shift = F.col(f"_mean_{name}") - F.col(f"_all_{name}")
        squares = F.sum(F.col(f"_square_{name}") + F.col("_n") * shift * shift)
        summary.append(F.max(f"_all_{name}").alias(f"mean_{name}"))
        summary.append(
            F.when(F.sum("_n") > 1, F.sqrt(F.try_divide(squares, F.sum("_n") - 1))).alias(
                f"std_{name}"
            )
        )
    return merged.groupBy(*by).agg(
        F.sum(F.col("_area") + F.col("_bridge")).alias("integral"),
        (F.max("_to") - F.min("_from")).alias("span"),
        F.sum("_n").alias("points"),
        *summary,
    )


def trapezoid_energy(seconds: DataFrame) -> DataFrame:
    """Energy and duration per test; a zero span counts the seconds instead."""
    duration = F.when(F.col("span") > 0, F.col("span")).otherwise(F.col("points"))
    described = series_summary(
        seconds.withColumnsRenamed({"mean_power_w": "power_w", "mean_freq_mhz": "freq_mhz"}),
        TEST, "relative_time", "power_w", ["freq_mhz", "power_w"],
    )
    return described.withColumnRenamed("integral", "energy_j").withColumn(
        "duration_s", duration.cast("bigint")
    ).drop("span", "points")


def energy_estimate(telemetry: DataFrame) -> DataFrame:
    """Frequency, power, energy and duration per (kd, test): one scan, no join."""
    cells = with_power(with_activity(host_seconds(telemetry)))
    return trapezoid_energy(cluster_seconds(cells)).select(
        *TEST, "mean_freq_mhz", "std_freq_mhz", "mean_power_w", "std_power_w",
        "energy_j", "duration_s",
    )


def energy_efficiency(estimates: DataFrame, published: DataFrame) -> DataFrame:
    """One wide row per kd: power, frequency, J per pod and mJ per operation.

    ``published`` has one row per system, hence the broadcast.
    """

    def pick(test: str, column: str):
        return F.max(F.when(F.col("test_type") == test, F.col(column)))

    idle, loaded, redis = fixed.TEST_TYPES
    wide = estimates.groupBy("kd").agg(
        pick(idle, "mean_power_w").alias("idle_power_w_mean"),
        pick(idle, "std_power_w").alias("idle_power_w_std"),
        pick(idle, "mean_freq_mhz").alias("idle_freq_mhz_mean"),
        pick(loaded, "mean_power_w").alias("cp_power_w_mean"),
        pick(loaded, "std_power_w").alias("cp_power_w_std"),
        pick(loaded, "energy_j").alias("cp_energy_j_mean"),
        pick(loaded, "duration_s").alias("cp_duration_s_mean"),
        pick(loaded, "mean_freq_mhz").alias("cp_freq_mhz_mean"),
        pick(redis, "mean_power_w").alias("dp_power_w_mean"),
        pick(redis, "std_power_w").alias("dp_power_w_std"),
        pick(redis, "mean_freq_mhz").alias("dp_freq_mhz_mean"),
        pick(redis, "energy_j").alias("_dp_energy_j"),
        pick(redis, "duration_s").alias("_dp_duration_s"),
    )
    operations = F.col("dp_ops") * F.col("_dp_duration_s")
    return (
        wide.join(F.broadcast(published.select("kd", "dp_ops")), "kd", "left")
        .withColumn("energy_per_pod_j", F.col("cp_energy_j_mean") / fixed.PODS_AT_SCALE)
        .withColumn("cp_overhead_w", F.col("cp_power_w_mean") - F.col("idle_power_w_mean"))
        .withColumn(
            "energy_per_op_mj",
            F.when(operations > 0, F.try_divide("_dp_energy_j", operations) * 1000),
        )
        .drop("dp_ops", "_dp_energy_j", "_dp_duration_s")
    )


def power_overhead(estimates: DataFrame) -> DataFrame:
    """Power under control-plane load minus idle power, per kd."""
    idle, loaded, _ = fixed.TEST_TYPES

    def watts(test: str):
        return F.max(F.when(F.col("test_type") == test, F.col("mean_power_w")))

    return (
        estimates.groupBy("kd")
        .agg((watts(loaded) - watts(idle)).alias("power_overhead_w"))
        .where(F.col("power_overhead_w").isNotNull())
    )


def completeness_matrix(estimates: DataFrame, published: DataFrame) -> DataFrame:
    """Dense (kd, test) grid with ``N/A`` for gaps and zeros for bars.

    The grid is unfolded from a fixed list of tests per system, so there is no
    product join.
    """
    tests = F.explode(F.array(*[F.lit(test) for test in fixed.TEST_TYPES])).alias("test_type")
    grid = published.select("kd", tests)
    found = estimates.select(*TEST, "mean_freq_mhz", "mean_power_w", "std_power_w")
    return grid.join(found, TEST, "left").select(
        *TEST,
        F.col("mean_freq_mhz").isNotNull().alias("has_data"),
        F.when(F.col("mean_freq_mhz").isNull(), "N/A")
        .otherwise(fixed_text(F.col("mean_freq_mhz"), 0))
        .alias("freq_label"),
        F.coalesce("mean_power_w", F.lit(0.0)).alias("power_w"),
        F.coalesce("std_power_w", F.lit(0.0)).alias("power_std_w"),
    )

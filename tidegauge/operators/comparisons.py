"""Comparisons of systems: start-up and API latency, efficiency, constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.operators.ranks import exact_median
from tidegauge.operators.statistics import spearman_of_systems

HEAVY = "cp_heavy_12client"


def with_label(rows: DataFrame, column: str, mapping: dict[str, str], name: str) -> DataFrame:
    """Display name of a key, the key itself where it has none.

    The mapping is a fixed table of a few rows, hence the broadcast.
    """
    names = fixed.labels(rows.sparkSession, mapping)
    return (
        rows.join(F.broadcast(names), rows[column] == names["key"], "left")
        .withColumn(name, F.coalesce("label", column))
        .drop("key", "label")
    )


def startup_by_kd_test(startup: DataFrame) -> DataFrame:
    """Mean and deviation of median start-up latency per (kd, test)."""
    return startup.groupBy("kd", "tests").agg(
        F.avg("medians").alias("mean_ms"), F.stddev_samp("medians").alias("std_ms")
    )


def startup_at_scale(startup: DataFrame, pods: int = fixed.PODS_AT_SCALE) -> DataFrame:
    """Mean of medians at the largest pod count under the heavy test."""
    return (
        startup.where((F.col("tests") == HEAVY) & (F.col("number_of_pods") == pods))
        .groupBy("kd")
        .agg(F.avg("medians").alias("latency_ms"))
    )


def operation_rows(api: DataFrame, operation: str, metric: str, test: str = HEAVY) -> DataFrame:
    """API latency rows of one operation under one test."""
    return api.where(
        (F.col("tests") == test)
        & (F.col("operations") == operation)
        & (F.col("metrics") == metric)
    )


def svc_create_median(api: DataFrame) -> DataFrame:
    """Median of medians of service creation, per kd."""
    rows = operation_rows(api, "service", "create")
    return exact_median(rows, ["kd"], "medians").withColumnRenamed("median", "median_ms")


def lightweight_flag(kd: str = "kd"):
    """True for lightweight systems, False for heavy ones, NULL for others."""
    column = F.col(kd)
    return F.when(column.isin(fixed.LIGHTWEIGHT_KDS), True).when(
        column.isin(fixed.HEAVY_KDS), False
    )


def group_mean_ratio(startup: DataFrame) -> DataFrame:
    """Lightweight against heavy systems: means, their ratio, tails."""
    light, heavy = lightweight_flag(), ~lightweight_flag()
    return startup.agg(
        F.avg(F.when(light, F.col("medians"))).alias("mean_lightweight_ms"),
        F.avg(F.when(heavy, F.col("medians"))).alias("mean_heavy_ms"),
        F.avg(F.when(light, F.col("maxs"))).alias("mean_lightweight_max_ms"),
        F.avg(F.when(heavy, F.col("maxs"))).alias("mean_heavy_max_ms"),
        F.avg(F.when(F.col("kd") == "kubeEdge", F.col("maxs"))).alias("mean_edge_max_ms"),
        F.max(F.when(F.col("kd") == "kubeEdge", F.col("maxs"))).alias("max_edge_max_ms"),
    ).withColumn(
        "ratio_heavy_to_lw",
        F.when(
            F.col("mean_lightweight_ms") > 0,
            F.try_divide("mean_heavy_ms", "mean_lightweight_ms"),
        ),
    )


def slowdown_ratio(at_scale: DataFrame, worst: str = "kubeEdge", best: str = "k3s") -> DataFrame:
    """Latency of the worst system over the best one, where both are positive."""

    def of(kd: str):
        return F.max(F.when(F.col("kd") == kd, F.col("latency_ms")))

    return (
        at_scale.agg(of(worst).alias("worst_ms"), of(best).alias("best_ms"))
        .where((F.col("worst_ms") > 0) & (F.col("best_ms") > 0))
        .withColumn("slowdown", F.col("worst_ms") / F.col("best_ms"))
    )


def measured_idle_cpu(series: DataFrame) -> DataFrame:
    """CPU use (100 minus idle) on the workers, with files and workers counted.

    Rows are folded per (kd, run, host) first, so the two distinct counts run
    over a handful of rows.  A kd with master rows only has NULL use.
    """
    worker = F.col("hostname").isin(fixed.WORKERS)
    cells = series.groupBy("kd", "run", "hostname").agg(
        F.sum("value").alias("_total"), F.count("value").alias("_n")
    )
    idle = F.try_divide(
        F.sum(F.when(worker, F.col("_total"))), F.sum(F.when(worker, F.col("_n")))
    )
    return cells.groupBy("kd").agg(
        (F.lit(100.0) - idle).alias("cpu_usage"),
        F.count_distinct("run").alias("n_files"),
        F.count_distinct(F.when(worker, F.col("hostname"))).alias("n_workers"),
    )


def idle_footprint(telemetry: DataFrame) -> DataFrame:
    """Measured idle CPU of the workers and container memory per kd, in one pass."""
    cpu = (
        (F.col("chart_context") == fixed.CTX_CPU)
        & (F.col("metric_id") == "idle")
        & F.col("hostname").isin(fixed.WORKERS)
    )
    memory = (F.col("chart_context") == "k8s.cgroup.mem_usage") & (F.col("metric_id") == "ram")
    return (
        telemetry.where((F.col("test_type") == "idle") & (cpu | memory))
        .groupBy("kd")
        .agg(
            (F.lit(100.0) - F.avg(F.when(cpu, F.col("value")))).alias("idle_cpu_pct"),
            F.avg(F.when(memory, F.col("value"))).alias("idle_ram_mib"),
        )
    )


def join_kd_constants(measured: DataFrame, published: DataFrame) -> DataFrame:
    """Measured values beside the published ones (five fixed rows, broadcast)."""
    return measured.join(F.broadcast(published), "kd")


def cross_validation(measured: DataFrame, published: DataFrame) -> DataFrame:
    """Measured against published idle CPU."""
    return measured.join(
        F.broadcast(published.select("kd", F.col("idle_cpu_pct").alias("published_pct"))), "kd"
    ).withColumn("difference_pct", F.col("cpu_usage") - F.col("published_pct"))


def throughput_efficiency(systems: DataFrame, ops: str = "dp_ops", cpu: str = "idle_cpu_pct"):
    """Operations per percent of idle CPU, and best over worst (at least 1).

    The window spans one row per system.
    """
    every = Window.partitionBy(F.lit(0))
    rows = systems.withColumn("ops_per_cpu", F.try_divide(ops, cpu))
    best, worst = F.max("ops_per_cpu").over(every), F.min("ops_per_cpu").over(every)
    return rows.withColumn("efficiency_spread", best / F.greatest(worst, F.lit(1.0)))


def latency_efficiency(systems: DataFrame, latency: str = "dp_latency_ms",
                       cpu: str = "idle_cpu_pct") -> DataFrame:
    """Inverse of latency times idle CPU."""
    return systems.withColumn(
        "latency_efficiency", F.try_divide(F.lit(1.0), F.col(latency) * F.col(cpu))
    )


def efficiency_ranking(rows: DataFrame, value: str, descending: bool = True) -> DataFrame:
    """Position of every system by a value; one row per system."""
    key = F.desc(value) if descending else F.asc(value)
    order = Window.partitionBy(F.lit(0)).orderBy(key, "kd")
    return rows.withColumn("position", F.row_number().over(order))


def freq_latency_corr(frequencies: DataFrame, published: DataFrame) -> DataFrame:
    """Four named correlations of worker frequency with published measurements.

    The comparison sets are unfolded from one joined table of (kd, test) rows
    and correlated in one pass.
    """
    loaded, redis = fixed.TEST_TYPES[1:]
    sets = [
        ("cp_freq_vs_pod_latency", loaded, "mean_freq_mhz", "startup_120_ms"),
        ("dp_freq_vs_dp_latency", redis, "mean_freq_mhz", "dp_latency_ms"),
        ("dp_freq_vs_throughput", redis, "mean_freq_mhz", "dp_ops"),
        ("cp_freq_cv_vs_pod_latency", loaded, "freq_cv", "startup_120_ms"),
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("comparison"),
                F.lit(test).alias("wanted"),
                F.col(x).alias("x"),
                F.col(y).alias("y"),
            )
            for name, test, x, y in sets
        ]
    )
    points = (
        join_kd_constants(frequencies, published)
        .select("test_type", F.inline(entries))
        .where(F.col("test_type") == F.col("wanted"))
    )
    return spearman_of_systems(points, ["comparison"], "x", "y").where(F.col("n") >= 3)

"""Classification of pods and the split into system and workload use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions.telemetry import pod_label

POD = ["kd", "hostname", "pod_uuid"]


def pod_inventory(silver: DataFrame) -> DataFrame:
    """Per (kd, host, pod): class, tests, number of runs, metrics.

    The two sets are bounded by the number of tests and of metrics, and are
    merged on the map side.  The single distinct count makes Spark group by
    run first instead of copying rows.
    """
    return silver.groupBy(*POD).agg(
        F.min("qos_class").alias("qos_class"),
        F.sort_array(F.collect_set("test_type")).alias("test_types"),
        F.count_distinct("run").alias("n_runs"),
        F.sort_array(F.collect_set("metric")).alias("contexts"),
    )


def pod_roles(silver: DataFrame) -> DataFrame:
    """Per (kd, pod): seen in an idle run makes it system, else workload."""
    idle = F.max(F.col("test_type") == "idle")
    return silver.groupBy("kd", "pod_uuid").agg(
        idle.alias("found_in_idle"),
        F.when(idle, "system").otherwise("workload").alias("role"),
    )


def pod_classification(silver: DataFrame) -> DataFrame:
    """Role and evidence of every pod of the inventory.

    The role depends on the pod alone, so a pod idle on one host is system on
    all of its hosts.
    """
    inventory = pod_inventory(silver)
    idle_here = F.array_contains("test_types", "idle")
    idle = F.max(idle_here).over(Window.partitionBy("kd", "pod_uuid"))
    return (
        inventory.withColumn("found_in_idle", idle)
        .withColumn("role", F.when(F.col("found_in_idle"), "system").otherwise("workload"))
        .withColumn(
            "classification_method",
            F.when(F.col("found_in_idle"), "idle_enumeration").otherwise("differential_analysis"),
        )
        .withColumn("found_in_loaded", F.array_remove("test_types", "idle"))
        .select(
            *POD, "qos_class", "role", "classification_method",
            "found_in_idle", "found_in_loaded", "contexts",
        )
    )


def unique_roles(classification: DataFrame) -> DataFrame:
    """One role per (kd, pod), whatever the number of hosts."""
    return classification.groupBy("kd", "pod_uuid").agg(F.max("role").alias("role"))


def join_role(rows: DataFrame, classification: DataFrame) -> DataFrame:
    """Attach the role, 'unknown' for an unclassified pod.

    The classification grows with the pods, so Spark chooses the join by size.
    """
    return rows.join(unique_roles(classification), ["kd", "pod_uuid"], "left").withColumn(
        "role", F.coalesce("role", F.lit("unknown"))
    )


def idle_overhead(silver: DataFrame, classification: DataFrame) -> DataFrame:
    """Mean and deviation over idle runs, per pod and metric."""
    summary = (
        silver.where(F.col("test_type") == "idle")
        .groupBy(*POD, "qos_class", "metric", "units")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.count("value").alias("n_runs"),
        )
    )
    return join_role(summary, classification).withColumn(
        "pod_label", pod_label(F.col("pod_uuid"))
    )


def idle_overhead_pivot(idle: DataFrame) -> DataFrame:
    """Pods by metrics; an absent cell is NULL."""
    return (
        idle.groupBy(*POD, "pod_label", "role", "qos_class")
        .pivot("metric", fixed.POD_METRIC_NAMES)
        .agg(F.avg("mean"))
    )


def idle_overhead_totals(idle: DataFrame) -> DataFrame:
    """Sum of means and root of summed squares of deviations, per metric."""
    return idle.groupBy("kd", "metric").agg(
        F.coalesce(F.sum("mean"), F.lit(0.0)).alias("total_mean"),
        F.sqrt(F.coalesce(F.sum(F.col("std") * F.col("std")), F.lit(0.0))).alias("total_std"),
    )


def capacity_share(rows: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Relate a metric to the capacity of its host (fixed four-row table)."""
    capacity = F.when(F.col("metric") == "cpu_pct", F.col("cpu_capacity")).when(
        F.col("metric") == "mem_mib", F.col("ram_mib")
    )
    return (
        rows.join(F.broadcast(nodes), "hostname")
        .withColumn("node_capacity", capacity)
        .where(F.col("node_capacity").isNotNull())
        .withColumn("capacity_pct", F.col(value) / F.col("node_capacity") * 100)
        .drop("node_type", "cores", "cpu_capacity", "ram_mib")
    )


def loaded_overhead(silver: DataFrame, classification: DataFrame) -> DataFrame:
    """System and workload use per (kd, test, role, metric).

    Values are summed over pods per run, then averaged over the runs present:
    an absent run is not a zero.  Distinct pods are counted at the outer key in
    a branch of their own; both branches read the small silver table.
    """
    known = join_role(silver, classification).where(F.col("role") != "unknown")
    key = ["kd", "test_type", "role", "metric"]
    runs = known.groupBy(*key, "run").agg(F.sum("value").alias("run_value"))
    pods = known.groupBy(*key).agg(F.count_distinct("pod_uuid").alias("n_pods"))
    return (
        runs.groupBy(*key)
        .agg(
            F.avg("run_value").alias("mean"),
            F.stddev_samp("run_value").alias("std"),
            F.count("run_value").alias("n_runs"),
        )
        .join(pods, key)
    )


def mean_system_cpu(silver: DataFrame) -> DataFrame:
    """Mean CPU of system pods per (kd, test): the system CPU part of ``loaded_overhead``.

    The role of a pod is a flag over its own silver rows, so nothing is joined and the
    silver table is read once: one shuffle by pod, one by run, one by test.
    """
    idle = F.max(F.col("test_type") == "idle").over(Window.partitionBy("kd", "pod_uuid"))
    system = silver.withColumn("_system", idle).where(F.col("_system") & (F.col("metric") == "cpu_pct"))
    runs = system.groupBy("kd", "test_type", "run").agg(F.sum("value").alias("run_value"))
    return runs.groupBy("kd", "test_type").agg(F.avg("run_value").alias("mean"))


def role_counts(silver: DataFrame, classification: DataFrame) -> DataFrame:
    """Distinct pods per (kd, test), in total and by role."""
    pods = (
        join_role(silver, classification).select("kd", "test_type", "pod_uuid", "role").distinct()
    )
    return pods.groupBy("kd", "test_type").agg(
        F.count("*").alias("n_pods"),
        F.count_if(F.col("role") == "system").alias("n_system"),
        F.count_if(F.col("role") == "workload").alias("n_workload"),
    )


def orchestration_tax(loaded: DataFrame, nodes: DataFrame) -> DataFrame:
    """System CPU and memory as a share of the worker's capacity."""
    on_node = loaded.where(F.col("role") == "system").withColumn(
        "hostname", F.lit(fixed.TAX_NODE)
    )
    return capacity_share(on_node, nodes, "mean").select(
        "kd", "test_type", "metric",
        F.col("mean").alias("system_overhead"), "node_capacity",
        F.col("capacity_pct").alias("orchestration_tax_pct"),
    )


def workload_share(loaded: DataFrame) -> DataFrame:
    """Workload CPU as a share of system plus workload CPU."""

    def use(role: str):
        return F.max(F.when(F.col("role") == role, F.col("mean")))

    return (
        loaded.where(F.col("metric") == "cpu_pct")
        .groupBy("kd", "test_type")
        .agg(use("system").alias("system_cpu"), use("workload").alias("workload_cpu"))
        .where(F.col("system_cpu").isNotNull() & F.col("workload_cpu").isNotNull())
        .withColumn(
            "workload_share_pct",
            F.try_divide(
                F.col("workload_cpu"), F.col("system_cpu") + F.col("workload_cpu")
            ) * 100,
        )
    )


def growth_factor(loaded: DataFrame) -> DataFrame:
    """System CPU of every test relative to the idle test of the same kd."""
    idle = F.max(F.when(F.col("test_type") == "idle", F.col("mean")))
    return (
        loaded.where((F.col("role") == "system") & (F.col("metric") == "cpu_pct"))
        .withColumn("idle_mean", idle.over(Window.partitionBy("kd")))
        .where(F.col("idle_mean").isNotNull())
        .select(
            "kd", "test_type", F.col("mean").alias("system_cpu"), "idle_mean",
            F.try_divide("mean", "idle_mean").alias("growth_factor"),
        )
    )


def top_pods(idle: DataFrame, metric: str, n: int | None = None) -> DataFrame:
    """Pods by mean of one metric, highest first within a kd.

    With ``n`` the rank filter lets Spark drop rows before the shuffle.
    """
    order = Window.partitionBy("kd").orderBy(F.desc("mean"), "hostname", "pod_uuid", "qos_class")
    rows = idle.where(F.col("metric") == metric)
    if n is None:
        return rows.orderBy("kd", F.desc("mean"), "hostname", "pod_uuid", "qos_class")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def pod_set_difference(silver: DataFrame) -> DataFrame:
    """Pods seen only under load: the workload side of the split."""
    return pod_roles(silver).where(~F.col("found_in_idle")).select("kd", "pod_uuid")

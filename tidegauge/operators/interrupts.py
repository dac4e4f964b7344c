"""Hardware and software interrupt rates.

Rates are formed per run first, so runs that share relative seconds do not
inflate each other.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.operators.scans import RUN, in_contexts, on_hosts

TEST = ["kd", "test_type"]


def irq_run_rate(telemetry: DataFrame) -> DataFrame:
    """Interrupts per second of each run.

    The mean over workers of per-worker sums is the total divided by the
    number of workers present.  Presence is a flag per worker, so one
    aggregation per second replaces two.
    """
    present = [
        F.coalesce(F.max(F.when(F.col("hostname") == host, 1)), F.lit(0)) for host in fixed.WORKERS
    ]
    workers = present[0]
    for flag in present[1:]:
        workers = workers + flag
    seconds = (
        on_hosts(in_contexts(telemetry, [fixed.CTX_IRQ]), fixed.WORKERS)
        .groupBy(*RUN, "relative_time")
        .agg((F.coalesce(F.sum("value"), F.lit(0.0)) / workers).alias("rate"))
    )
    return seconds.groupBy(*RUN).agg(F.avg("rate").alias("irq_rate"))


def irq_rate(run_rates: DataFrame) -> DataFrame:
    """Mean and sample deviation over runs; one run has deviation 0."""
    return run_rates.groupBy(*TEST).agg(
        F.avg("irq_rate").alias("total_irq_rate_mean"),
        F.coalesce(F.stddev_samp("irq_rate"), F.lit(0.0)).alias("total_irq_rate_std"),
    )


def irq_amplification(rates: DataFrame) -> DataFrame:
    """Rate of every test relative to the idle rate of the same kd.

    The rates hold one row per test, so the window groups are that small.
    """
    idle = F.max(F.when(F.col("test_type") == "idle", F.col("total_irq_rate_mean")))
    return (
        rates.withColumn("idle_irq_rate", idle.over(Window.partitionBy("kd")))
        .where(F.col("idle_irq_rate") > 0)
        .select(
            *TEST,
            "idle_irq_rate",
            F.col("total_irq_rate_mean").alias("loaded_irq_rate"),
            (F.col("total_irq_rate_mean") / F.col("idle_irq_rate")).alias("amplification_factor"),
        )
    )


def softirq_runs(telemetry: DataFrame) -> DataFrame:
    """Mean rate per run and category."""
    return (
        on_hosts(in_contexts(telemetry, [fixed.CTX_SOFTIRQ]), fixed.WORKERS)
        .groupBy(*RUN, F.col("metric_id").alias("category"))
        .agg(F.avg("value").alias("rate"))
    )


def softirq_run_totals(categories: DataFrame) -> DataFrame:
    """Total over categories per run."""
    return categories.groupBy(*RUN).agg(
        F.coalesce(F.sum("rate"), F.lit(0.0)).alias("softirq_rate")
    )


def softirq_breakdown(categories: DataFrame) -> DataFrame:
    """Per test and category: mean over the runs that have it, and its share.

    Windows run over one row per category.
    """
    totals = softirq_run_totals(categories).groupBy(*TEST).agg(
        F.avg("softirq_rate").alias("total_softirq_rate_mean")
    )
    means = categories.groupBy(*TEST, "category").agg(F.avg("rate").alias("rate_mean"))
    whole = F.sum("rate_mean").over(Window.partitionBy(*TEST))
    share = F.when(whole > 0, F.try_divide(F.col("rate_mean"), whole)).otherwise(F.lit(0.0))
    return means.withColumn("proportion", share).join(totals, TEST)


def listed_or_other(column: str, names: list[str]) -> Column:
    """The value if it is listed, else ``other``: a pivot then loses no row."""
    return F.when(F.col(column).isin(names), F.col(column)).otherwise(fixed.OTHER)


def softirq_wide(breakdown: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Categories side by side as ``{category}_mean`` and ``{category}_proportion``.

    Unlisted categories are added up under ``other``, so shares add up to 1.
    """
    names = categories or fixed.SOFTIRQ_CATEGORIES
    return (
        breakdown.withColumn("category", listed_or_other("category", names))
        .groupBy(*TEST, "total_softirq_rate_mean")
        .pivot("category", [*names, fixed.OTHER])
        .agg(F.sum("rate_mean").alias("mean"), F.sum("proportion").alias("proportion"))
    )


def softnet_summary(telemetry: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """Per run: mean and maximum of every network soft-interrupt dimension.

    Readings of unlisted dimensions share the columns of ``other``.
    """
    names = dimensions or fixed.SOFTNET_DIMENSIONS
    return (
        on_hosts(in_contexts(telemetry, [fixed.CTX_SOFTNET]), fixed.WORKERS)
        .withColumn("metric_id", listed_or_other("metric_id", names))
        .groupBy(*RUN)
        .pivot("metric_id", [*names, fixed.OTHER])
        .agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    )


def cstate_breakdown(
    telemetry: DataFrame, nodes: DataFrame, states: list[str] | None = None
) -> DataFrame:
    """Per run and node type: mean and deviation of every idle state.

    Readings of unlisted states share the columns of ``other``.  ``nodes`` has one row per host of the fixed cluster, hence the broadcast.
    """
    names = states or fixed.CSTATES
    return (
        in_contexts(telemetry, [fixed.CTX_CSTATE])
        .join(F.broadcast(nodes.select("hostname", "node_type")), "hostname")
        .withColumn("metric_id", listed_or_other("metric_id", names))
        .groupBy(*RUN, "node_type")
        .pivot("metric_id", [*names, fixed.OTHER])
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )


def interrupt_runs(telemetry: DataFrame) -> DataFrame:
    """Hard and soft interrupt rate of each run, from one scan.

    A cell is a second of the hard interrupts or a category of the soft ones.  A
    run with one kind only has NULL for the other.
    """
    present = [
        F.coalesce(F.max(F.when(F.col("hostname") == host, 1)), F.lit(0)) for host in fixed.WORKERS
    ]
    hard = F.col("chart_context") == fixed.CTX_IRQ
    cell = F.when(hard, F.col("relative_time").cast("string")).otherwise(F.col("metric_id"))
    cells = (
        on_hosts(in_contexts(telemetry, [fixed.CTX_IRQ, fixed.CTX_SOFTIRQ]), fixed.WORKERS)
        .groupBy(*RUN, hard.alias("_hard"), cell.alias("_cell"))
        .agg(
            (F.coalesce(F.sum("value"), F.lit(0.0)) / reduce(add, present)).alias("_second"),
            F.coalesce(F.avg("value"), F.lit(0.0)).alias("_category"),
        )
    )
    return cells.groupBy(*RUN).agg(
        F.avg(F.when(F.col("_hard"), F.col("_second"))).alias("irq_rate"),
        F.sum(F.when(~F.col("_hard"), F.col("_category"))).alias("softirq_rate"),
    )


def irq_cpu_overhead(rates: DataFrame) -> DataFrame:
    """CPU share spent on hard and soft interrupts, per run.

    ``rates`` has irq_rate and softirq_rate; an absent kind adds nothing to the total.
    """
    cost = F.lit(fixed.CPU_PCT_PER_INTERRUPT)
    return (
        rates.withColumn("irq_cpu_overhead_pct", F.col("irq_rate") * cost)
        .withColumn("softirq_cpu_overhead_pct", F.col("softirq_rate") * cost)
        .withColumn(
            "total_cpu_overhead_pct",
            F.coalesce("irq_cpu_overhead_pct", F.lit(0.0))
            + F.coalesce("softirq_cpu_overhead_pct", F.lit(0.0)),
        )
    )

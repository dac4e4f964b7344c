"""The four batch jobs, from stored inputs to stored results.

Each job reads its inputs through the readers, writes a reduced table once
where several results need it, and writes every result from the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.operators import (
    comparisons,
    energy,
    frequency,
    ingest,
    interrupts,
    overhead,
    scans,
    silver,
    silver_states,
    statistics,
    verdicts,
)
from tidegauge.session import broadcast_if_small, checkpointed, job_folder, written
from tidegauge.sinks import tables as sinks
from tidegauge.sources import telemetry as sources


def in_job_folder(job: Callable[..., None]) -> Callable[..., None]:
    """Run a job with a folder of its own for the tables it writes on its way."""

    @wraps(job)
    def run(first: DataFrame | SparkSession, *args, **kwargs) -> None:
        spark = first if isinstance(first, SparkSession) else first.sparkSession
        with job_folder(spark, job.__name__):
            job(first, *args, **kwargs)

    return run


@in_job_folder
def run_ingest(
    files: DataFrame, raw_documents: DataFrame, requested: DataFrame, out: str,
    skip_existing: bool = True,
) -> None:
    """Run logs and documents to a registry, run folders and a manifest.

    ``requested`` lists the wanted (kd, test_type, run).  With
    ``skip_existing`` runs that have rows in the target are left alone.  Run
    folders are sorted by context first, which the analyses read best.
    """
    spark = files.sparkSession
    registry = checkpointed(ingest.run_registry(files))
    sinks.write_json(registry, f"{out}/tag_registry")
    sinks.write_json(ingest.registry_coverage(registry), f"{out}/registry_coverage")
    target = f"{out}/runs"
    existing = None
    todo = requested
    if skip_existing:
        stored = sources.read_telemetry(spark, target).select(*scans.RUN).distinct()
        existing = checkpointed(stored)
        todo = requested.join(existing, scans.RUN, "left_anti")
    wanted = checkpointed(todo)
    entries = checkpointed(
        registry.join(wanted.withColumnRenamed("run", "run_num"), ingest.ENTRY, "left_semi")
    )
    resolved = checkpointed(ingest.tag_resolve(entries, raw_documents))
    rows = ingest.extract_resolved(entries, resolved, raw_documents)
    sinks.write_runs(rows, target, by_context=True)
    stored = sources.read_telemetry(spark, target)
    fresh = stored.join(broadcast_if_small(wanted), scans.RUN, "left_semi")
    profile = ingest.ingest_profile(fresh)
    manifest = ingest.manifest(requested, registry, resolved, profile, existing)
    sinks.write_json(
        manifest.join(ingest.run_sizes(stored), scans.RUN, "left"), f"{out}/extraction_manifest"
    )


@in_job_folder
def run_energy(telemetry: DataFrame, out: str) -> None:
    """All energy, interrupt, throttling and frequency results."""
    spark = telemetry.sparkSession
    published, nodes = fixed.published(spark), fixed.nodes(spark)
    tests = telemetry.where(F.col("test_type").isin(fixed.TEST_TYPES))

    estimates = written(energy.energy_estimate(tests), "estimates")
    irq_runs = written(interrupts.irq_run_rate(tests), "irq-runs")
    soft_runs = written(interrupts.softirq_runs(tests), "softirq-runs")
    throttle = written(frequency.throttle_rate(tests), "throttle")
    moments = written(frequency.run_moments(tests), "freq-moments")
    speeds = written(frequency.stats_of(moments), "freq-stats")
    rates = interrupts.irq_rate(irq_runs)
    correlations = written(comparisons.freq_latency_corr(speeds, published), "correlations")
    results = {
        "energy_estimates": estimates,
        "energy_efficiency": energy.energy_efficiency(estimates, published),
        "power_overhead": energy.power_overhead(estimates),
        "completeness": energy.completeness_matrix(estimates, published),
        "interrupt_rates": rates,
        "interrupt_amplification": interrupts.irq_amplification(rates),
        "interrupt_cross_kd": statistics.irq_cross_kd(irq_runs),
        "interrupt_cpu_overhead": interrupts.irq_cpu_overhead(
            irq_runs.join(interrupts.softirq_run_totals(soft_runs), scans.RUN, "full")
        ),
        "softirq_breakdown": interrupts.softirq_wide(interrupts.softirq_breakdown(soft_runs)),
        # one row per category, whatever its name
        "softirq_categories": interrupts.softirq_breakdown(soft_runs),
        "softnet_analysis": interrupts.softnet_summary(tests),
        "cstate_breakdown": interrupts.cstate_breakdown(tests, nodes),
        "throttling_rates": throttle,
        "throttling_zero": frequency.all_zero_throttle(throttle),
        "frequency_distributions": speeds,
        "frequency_throttling": frequency.below_of(moments),
        "frequency_latency": frequency.with_stars(correlations),
        # the same table under its older name
        "throttling_latency": correlations,
        "thermal_stability": frequency.thermal_stability(
            throttle.join(
                speeds.withColumn("has_frequencies", F.lit(True)), ["kd", "test_type"], "full"
            ),
            published,
        ),
    }
    for name, result in results.items():
        sinks.write_result_csv(result, f"{out}/{name}")


@in_job_folder
def run_overhead(telemetry: DataFrame, out: str) -> None:
    """Silver table, classification, idle and loaded overhead, tax."""
    tests = telemetry.where(F.col("test_type").isin(fixed.TEST_TYPES))
    definitions = fixed.pod_metrics(telemetry.sparkSession)
    _overhead_results(silver.silver_table(tests, definitions), out)


@in_job_folder
def run_growing_overhead(spark: SparkSession, runs: str, states: str, out: str) -> None:
    """The overhead results of stored run folders; only new or replaced runs are scanned.

    ``states`` is the folder in which the silver layer grows from job to job.
    """
    definitions = fixed.pod_metrics(spark)
    silver_states.grow_silver(spark, runs, states, definitions)
    grown = silver_states.silver_of(silver_states.read_states(spark, states), definitions)
    _overhead_results(grown.where(F.col("test_type").isin(fixed.TEST_TYPES)), out)


def _overhead_results(rows: DataFrame, out: str) -> None:
    """All results over a silver table.

    Silver table and classification lie in buckets of (kd, pod) while they are joined,
    so that none of the joins shuffles them again.
    """
    spark = rows.sparkSession
    nodes = fixed.nodes(spark)
    sinks.write_silver(rows, f"{out}/silver")
    stored = sources.read_silver(spark, f"{out}/silver")
    by_pod = ["kd", "pod_uuid"]
    with sinks.bucketed(stored, "silver", by_pod) as table:
        sinks.write_json(overhead.pod_classification(table), f"{out}/pod_classification")
        listed = sources.read_classification(spark, f"{out}/pod_classification")
        with sinks.bucketed(listed, "classes", by_pod) as classes:
            idle = written(overhead.idle_overhead(table, classes), "idle")
            loaded = written(overhead.loaded_overhead(table, classes), "loaded")
            results = {
                "idle_overhead": idle,
                "idle_overhead_pivot": overhead.idle_overhead_pivot(idle),
                "idle_overhead_totals": overhead.idle_overhead_totals(idle),
                "loaded_overhead": loaded,
                "role_counts": overhead.role_counts(table, classes),
                "orchestration_tax": overhead.orchestration_tax(loaded, nodes),
                "workload_share": overhead.workload_share(loaded),
                "growth_factor": overhead.growth_factor(loaded),
            }
            for name, result in results.items():
                sinks.write_result_csv_fixed(result, f"{out}/{name}")


@in_job_folder
def run_hypotheses(
    spark: SparkSession,
    startup: DataFrame,
    api: DataFrame,
    growth: DataFrame,
    series: DataFrame,
    out: str,
    loaded: DataFrame | None = None,
) -> None:
    """The six verdicts with their numbers, start-up tables, the check of published idle CPU.

    With ``loaded`` (loaded overhead) workload shares are among the numbers.
    """
    published = fixed.published(spark)
    # both rank tests and the medians per system come from one ranking of all samples
    ranked = written(
        statistics.rank_pass(
            verdicts.verdict_samples(startup, api), ["comparison", "kd"], "value", F.col("is_first")
        ),
        "rank-pass",
    )
    medians = ranked.where("comparison = 'svc_create'").select("kd", F.col("median").alias("median_ms"))
    points = written(published.join(medians, "kd", "left"), "points")
    correlations = written(verdicts.system_correlations(points), "correlations-of-systems")
    test = ranked.where("comparison = 'startup'")
    rows = [
        verdicts.verdict_p1(correlations),
        verdicts.verdict_p2(correlations, growth),
        verdicts.verdict_p3(test, comparisons.group_mean_ratio(startup)),
        verdicts.verdict_p10(correlations, comparisons.throughput_efficiency(published)),
        verdicts.verdict_p12(correlations),
        verdicts.verdict_p14(correlations),
    ]
    at_scale = written(comparisons.startup_at_scale(startup), "startup-at-scale")
    slowdown = comparisons.slowdown_ratio(at_scale)
    by_test = written(comparisons.startup_by_kd_test(startup), "startup-by-test")
    efficiency = written(
        comparisons.latency_efficiency(comparisons.throughput_efficiency(published)), "efficiency"
    )
    create_test = ranked.where("comparison = 'pod_create'").select(
        F.lit(comparisons.HEAVY).alias("test_type"), "n1", "n2", "u_statistic", "p_value"
    )
    means = written(comparisons.group_mean_ratio(startup), "group-means")
    numbers = [
        verdicts.evidence_rows("P2", "startup_at_scale_ms", at_scale, "latency_ms"),
        verdicts.evidence_rows("P2", "slowdown", slowdown, "slowdown"),
        verdicts.evidence_rows("P2", "service_create_median_ms", points, "median_ms"),
        verdicts.evidence_rows("P2", "growth_factor", growth, "growth_factor"),
        verdicts.evidence_rows(
            "P3", "startup_mean_ms", by_test.withColumnRenamed("tests", "test_type"), "mean_ms"
        ),
        verdicts.evidence_rows("P3", "pod_create_mann_whitney_U", create_test, "u_statistic"),
        verdicts.evidence_rows("P3", "pod_create_mann_whitney_p", create_test, "p_value"),
        *[verdicts.evidence_rows("P3", name, means, name) for name in means.columns],
        verdicts.evidence_rows("P10", "ops_per_cpu", efficiency, "ops_per_cpu"),
    ]
    if loaded is not None:
        shares = overhead.workload_share(loaded)
        numbers.append(verdicts.evidence_rows("P10", "workload_share_pct", shares, "workload_share_pct"))
    evidence = written(reduce(lambda a, b: a.unionByName(b), numbers), "verdict-numbers")
    table = written(reduce(lambda a, b: a.unionByName(b), rows), "verdicts")
    sinks.write_verdicts(
        verdicts.with_numbers(table, evidence),
        f"{out}/proposition_validation",
        f"{out}/proposition_details",
    )
    results = {
        "verdict_summary": verdicts.verdict_summary(table),
        "verdict_numbers": evidence,
        "group_mean_ratio": means,
        "pod_create_rank_test": create_test,
        "startup_by_kd_test": by_test,
        "startup_at_scale": at_scale,
        "slowdown": slowdown,
        "service_create_median": points.select("kd", "idle_cpu_pct", "median_ms"),
        "efficiency_ranking": comparisons.efficiency_ranking(efficiency, "ops_per_cpu"),
        "idle_cpu_check": comparisons.cross_validation(
            comparisons.measured_idle_cpu(series), published
        ),
    }
    for name, result in results.items():
        sinks.write_result_csv(result, f"{out}/{name}")

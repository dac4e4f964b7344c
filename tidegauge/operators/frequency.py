"""Worker frequency statistics, throttling and thermal summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions.labels import stars
from tidegauge.operators.scans import RUN, in_contexts, on_hosts, worker_cores

TEST = ["kd", "test_type"]


def worker_frequencies(telemetry: DataFrame) -> DataFrame:
    """Raw frequency samples of the worker cores."""
    return worker_cores(on_hosts(in_contexts(telemetry, [fixed.CTX_FREQ]), fixed.WORKERS))


def variation(mean: Column, std: Column) -> Column:
    """Coefficient of variation, 0 where the mean is not positive."""
    return F.when(mean > 0, F.try_divide(std, mean)).otherwise(F.lit(0.0))


def freq_stats(telemetry: DataFrame) -> DataFrame:
    """Mean, minimum, population deviation and variation over raw samples."""
    return (
        worker_frequencies(telemetry)
        .groupBy(*TEST)
        .agg(
            F.avg("value").alias("mean_freq_mhz"),
            F.min("value").alias("min_freq_mhz"),
            F.stddev_pop("value").alias("std_freq_mhz"),
        )
        .withColumn("freq_cv", variation(F.col("mean_freq_mhz"), F.col("std_freq_mhz")))
    )


def freq_below_threshold(
    telemetry: DataFrame, threshold: float = fixed.FREQ_MAX_MHZ * fixed.LOW_FREQ_SHARE
) -> DataFrame:
    """Per run: frequency level and share of samples below the threshold.

    The one distinct count makes Spark aggregate per (run, second) first and
    merge the other aggregates from there, so rows are neither copied nor
    shuffled raw.
    """
    return (
        worker_frequencies(telemetry)
        .groupBy(*RUN)
        .agg(
            F.avg("value").alias("mean_freq_mhz"),
            F.min("value").alias("min_freq_mhz"),
            F.avg(F.when(F.col("value") < threshold, 100.0).otherwise(0.0)).alias(
                "pct_below_threshold"
            ),
            F.count_distinct("relative_time").alias("n_samples"),
            F.stddev_pop("value").alias("freq_std_mhz"),
        )
        .withColumn("threshold_mhz", F.lit(float(threshold)))
        .withColumn("freq_cv", variation(F.col("mean_freq_mhz"), F.col("freq_std_mhz")))
    )


def run_moments(
    telemetry: DataFrame, threshold: float = fixed.FREQ_MAX_MHZ * fixed.LOW_FREQ_SHARE
) -> DataFrame:
    """Per run: count, mean, deviation, minimum and share below the threshold.

    Both frequency tables follow from this one pass (``stats_of``, ``below_of``).
    """
    return (
        worker_frequencies(telemetry)
        .groupBy(*RUN)
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.min("value").alias("least"),
            F.stddev_pop("value").alias("deviation"),
            F.avg(F.when(F.col("value") < threshold, 100.0).otherwise(0.0)).alias("pct_below"),
            F.count_distinct("relative_time").alias("n_samples"),
        )
        .withColumn("threshold_mhz", F.lit(float(threshold)))
    )


def stats_of(moments: DataFrame) -> DataFrame:
    """``freq_stats`` from the moments of runs.

    Squares about the pooled mean are those about the run means plus those of the
    run means themselves; the windows span the runs of a test.
    """
    test = Window.partitionBy(*TEST)
    n = F.col("n")
    pooled = F.try_divide(F.sum(n * F.col("mean")).over(test), F.sum(n).over(test))
    square = n * (F.col("deviation") * F.col("deviation") + F.pow(F.col("mean") - pooled, 2))
    return (
        moments.withColumns({"_mean": pooled, "_square": square})
        .groupBy(*TEST)
        .agg(
            F.max("_mean").alias("mean_freq_mhz"),
            F.min("least").alias("min_freq_mhz"),
            F.sqrt(F.try_divide(F.sum("_square"), F.sum("n"))).alias("std_freq_mhz"),
        )
        .withColumn("freq_cv", variation(F.col("mean_freq_mhz"), F.col("std_freq_mhz")))
    )


def below_of(moments: DataFrame) -> DataFrame:
    """``freq_below_threshold`` from the moments of runs."""
    return moments.select(
        *RUN,
        F.col("mean").alias("mean_freq_mhz"),
        F.col("least").alias("min_freq_mhz"),
        F.col("pct_below").alias("pct_below_threshold"),
        "n_samples",
        F.col("deviation").alias("freq_std_mhz"),
        "threshold_mhz",
        variation(F.col("mean"), F.col("deviation")).alias("freq_cv"),
    )


def throttle_runs(telemetry: DataFrame) -> DataFrame:
    """Per run: throttle events per second summed over the master's cores."""
    seconds = (
        on_hosts(in_contexts(telemetry, [fixed.CTX_THROTTLE]), [fixed.MASTER])
        .groupBy(*RUN, "relative_time")
        .agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("events"))
    )
    return seconds.groupBy(*RUN).agg(
        F.avg("events").alias("run_mean"),
        F.max("events").alias("run_max"),
        F.avg(F.when(F.col("events") > 0, 100.0).otherwise(0.0)).alias("run_pct_nonzero"),
    )


def throttle_rate(telemetry: DataFrame) -> DataFrame:
    """Throttling per (kd, test), averaged over runs."""
    return (
        throttle_runs(telemetry)
        .groupBy(*TEST)
        .agg(
            F.avg("run_mean").alias("throttle_rate_mean"),
            F.max("run_max").alias("throttle_rate_max"),
            F.avg("run_pct_nonzero").alias("pct_nonzero"),
        )
    )


def all_zero_throttle(rates: DataFrame) -> DataFrame:
    """Per kd: is every mean zero, how many tests were seen, the highest rate."""
    return rates.groupBy("kd").agg(
        F.bool_and(F.col("throttle_rate_mean") == 0).alias("all_zero"),
        F.count("*").alias("n_tests"),
        F.max("throttle_rate_max").alias("throttle_max"),
    )


def thermal_levels(telemetry: DataFrame) -> DataFrame:
    """Per (kd, test): highest throttling, mean and lowest frequency, from one scan."""
    throttling = (F.col("chart_context") == fixed.CTX_THROTTLE) & (
        F.col("hostname") == fixed.MASTER
    )
    clock = (
        (F.col("chart_context") == fixed.CTX_FREQ)
        & F.col("hostname").isin(fixed.WORKERS)
        & F.col("metric_id").isin(fixed.WORKER_CORES)
    )
    speed = F.when(clock, F.col("value"))
    seconds = (
        in_contexts(telemetry, [fixed.CTX_THROTTLE, fixed.CTX_FREQ])
        .where(throttling | clock)
        .groupBy(*RUN, "relative_time")
        .agg(
            F.when(
                F.count_if(throttling) > 0,
                F.coalesce(F.sum(F.when(throttling, F.col("value"))), F.lit(0.0)),
            ).alias("events"),
            F.sum(speed).alias("_sum"),
            F.count(speed).alias("_n"),
            F.min(speed).alias("_min"),
            F.count_if(clock).alias("_seen"),
        )
    )
    return seconds.groupBy(*TEST).agg(
        F.max("events").alias("throttle_rate_max"),
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_freq_mhz"),
        F.min("_min").alias("min_freq_mhz"),
        (F.sum("_seen") > 0).alias("has_frequencies"),
    )


def thermal_stability(levels: DataFrame, published: DataFrame) -> DataFrame:
    """Per kd: highest throttling, mean of mean frequencies, lowest frequency.

    ``levels`` has one row per (kd, test).  Every system keeps its row, with NULLs
    where it has no data.  The number of runs is the nominal one: tests with
    frequencies times runs per test.
    """
    tests = F.count_if(F.col("has_frequencies"))
    found = levels.groupBy("kd").agg(
        F.max("throttle_rate_max").alias("master_throttle_events"),
        F.avg("mean_freq_mhz").alias("worker_mean_freq_mhz"),
        F.min("min_freq_mhz").alias("worker_min_freq_mhz"),
        F.when(tests > 0, tests * fixed.RUNS_PER_TEST).alias("runs_analysed"),
    )
    return published.select("kd").join(found, "kd", "left")


def with_stars(correlations: DataFrame) -> DataFrame:
    """Add significance stars to a correlation table."""
    return correlations.withColumn("significance", stars(F.col("p_value")))

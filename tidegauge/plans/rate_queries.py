"""Interrupt, throttling and frequency queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.operators import frequency, interrupts, statistics
from tidegauge.plans.inputs import TELEMETRY
from tidegauge.plans.registry import query
from tidegauge.session import written

WORKERS = "hostname IN ('node_1', 'node_2', 'node_3')"
RATES = TELEMETRY.rstrip() + f""", irq_sums AS (
  SELECT kd, test_type, run, relative_time, hostname, coalesce(sum(value), 0.0) AS total FROM telemetry
  WHERE chart_context = 'system.interrupts' AND {WORKERS} GROUP BY ALL
), irq_seconds AS (
  SELECT kd, test_type, run, relative_time, avg(total) AS rate FROM irq_sums GROUP BY ALL
), irq_runs AS (
  SELECT kd, test_type, run, avg(rate) AS irq_rate FROM irq_seconds GROUP BY ALL
), irq_rates AS (
  SELECT kd, test_type, avg(irq_rate) AS total_irq_rate_mean,
    coalesce(stddev_samp(irq_rate), 0.0) AS total_irq_rate_std FROM irq_runs GROUP BY ALL
), soft_runs AS (
  SELECT kd, test_type, run, metric_id AS category, avg(value) AS rate FROM telemetry
  WHERE chart_context = 'system.softirqs' AND {WORKERS} GROUP BY ALL
), soft_totals AS (
  SELECT kd, test_type, run, sum(rate) AS softirq_rate FROM soft_runs GROUP BY ALL
), soft_means AS (
  SELECT kd, test_type, category, avg(rate) AS rate_mean FROM soft_runs GROUP BY ALL
), breakdown AS (
  SELECT m.kd, m.test_type, m.category, m.rate_mean,
    CASE WHEN w.whole > 0 THEN m.rate_mean / w.whole ELSE 0.0 END AS proportion, w.total_softirq_rate_mean
  FROM soft_means m JOIN (
    SELECT s.kd, s.test_type, sum(s.rate_mean) AS whole, any_value(a.total) AS total_softirq_rate_mean
    FROM soft_means s JOIN (SELECT kd, test_type, avg(softirq_rate) AS total FROM soft_totals GROUP BY ALL) a
      USING (kd, test_type) GROUP BY s.kd, s.test_type
  ) w ON m.kd = w.kd AND m.test_type = w.test_type
), throttle_seconds AS (
  SELECT kd, test_type, run, relative_time, coalesce(sum(value), 0.0) AS events FROM telemetry
  WHERE chart_context = 'cpu.core_throttling' AND hostname = 'master' GROUP BY ALL
), throttle_runs AS (
  SELECT kd, test_type, run, avg(events) AS a, max(events) AS m,
    avg(CASE WHEN events > 0 THEN 100.0 ELSE 0.0 END) AS p FROM throttle_seconds GROUP BY ALL
), throttle AS (
  SELECT kd, test_type, avg(a) AS throttle_rate_mean, max(m) AS throttle_rate_max, avg(p) AS pct_nonzero
  FROM throttle_runs GROUP BY ALL
), freq_rows AS (
  SELECT * FROM telemetry WHERE chart_context = 'cpufreq.cpufreq' AND {WORKERS}
    AND metric_id IN ('cpu0', 'cpu1', 'cpu2', 'cpu3')
), freq_stats AS (
  SELECT kd, test_type, avg(value) AS mean_freq_mhz, min(value) AS min_freq_mhz,
    stddev_pop(value) AS std_freq_mhz,
    CASE WHEN avg(value) > 0 THEN stddev_pop(value) / avg(value) ELSE 0.0 END AS freq_cv
  FROM freq_rows GROUP BY ALL
)
"""


@query("irq_run_rate", ctes=RATES, sql="SELECT * FROM irq_runs", rounds="irq_rate")
def irq_run_rate(t):
    return interrupts.irq_run_rate(t.telemetry)


def rates(t):
    return interrupts.irq_rate(interrupts.irq_run_rate(t.telemetry))


@query(
    "irq_rate", ctes=RATES, sql="SELECT * FROM irq_rates",
    rounds="total_irq_rate_mean total_irq_rate_std",
)
def irq_rate(t):
    return rates(t)


AMPLIFICATION = """SELECT l.kd, l.test_type, i.total_irq_rate_mean AS idle_irq_rate,
      l.total_irq_rate_mean AS loaded_irq_rate,
      l.total_irq_rate_mean / i.total_irq_rate_mean AS amplification_factor
    FROM irq_rates l JOIN irq_rates i ON l.kd = i.kd AND i.test_type = 'idle'
    WHERE i.total_irq_rate_mean > 0"""


@query(
    "irq_amplification", ctes=RATES, sql=AMPLIFICATION,
    rounds="idle_irq_rate loaded_irq_rate amplification_factor",
)
def irq_amplification(t):
    return interrupts.irq_amplification(rates(t))


@query(
    "join_idle_baseline",
    ctes=RATES,
    sql="""SELECT l.kd, l.test_type, l.total_irq_rate_mean AS rate, i.total_irq_rate_mean AS idle_rate
    FROM irq_rates l LEFT JOIN irq_rates i ON l.kd = i.kd AND i.test_type = 'idle'""",
    rounds="rate idle_rate",
)
def join_idle_baseline(t):
    idle = F.max(F.when(F.col("test_type") == "idle", F.col("total_irq_rate_mean")))
    return rates(t).select(
        "kd", "test_type", F.col("total_irq_rate_mean").alias("rate"),
        idle.over(Window.partitionBy("kd")).alias("idle_rate"),
    )


def breakdown(t):
    # two aggregations read the per-run rates; they are written once
    runs = written(interrupts.softirq_runs(t.telemetry), "softirq-runs")
    return interrupts.softirq_breakdown(runs)


@query(
    "softirq_breakdown", ctes=RATES, sql="SELECT * FROM breakdown",
    rounds="rate_mean proportion total_softirq_rate_mean",
)
def softirq_breakdown(t):
    return breakdown(t)


@query(
    "share_of_total",
    ctes=RATES,
    sql="""SELECT kd, test_type, category,
      rate_mean / sum(rate_mean) OVER (PARTITION BY kd, test_type) AS proportion FROM soft_means""",
    rounds="proportion",
    digits=9,
)
def share_of_total(t):
    return breakdown(t).select("kd", "test_type", "category", "proportion")


def in_column(column: str, name: str, listed: list[str]) -> str:
    """SQL condition of one column of a wide table; ``other`` takes what is not listed."""
    if name != fixed.OTHER:
        return f"{column} = '{name}'"
    names = ", ".join(f"'{n}'" for n in listed)
    return f"({column} IS NULL OR {column} NOT IN ({names}))"


SOFT_NAMES = [*fixed.SOFTIRQ_CATEGORIES, fixed.OTHER]
SOFT_WIDE = ", ".join(
    f"sum({value}) FILTER ({in_column('category', c, fixed.SOFTIRQ_CATEGORIES)}) AS {c}_{part}"
    for c in SOFT_NAMES
    for value, part in (("rate_mean", "mean"), ("proportion", "proportion"))
)
SOFT_COLUMNS = " ".join(f"{c}_{part}" for c in SOFT_NAMES for part in ("mean", "proportion"))


@query(
    "softirq_wide",
    ctes=RATES,
    sql=f"""SELECT kd, test_type, any_value(total_softirq_rate_mean) AS total_softirq_rate_mean, {SOFT_WIDE}
    FROM breakdown GROUP BY kd, test_type""",
    rounds=f"total_softirq_rate_mean {SOFT_COLUMNS}",
)
def softirq_wide(t):
    return interrupts.softirq_wide(breakdown(t))


SOFTNET = [*fixed.SOFTNET_DIMENSIONS, fixed.OTHER]


@query(
    "softnet_summary",
    ctes=TELEMETRY,
    sql="SELECT kd, test_type, run, "
    + ", ".join(
        f"{how}(value) FILTER ({in_column('metric_id', d, fixed.SOFTNET_DIMENSIONS)}) AS {d}_{part}"
        for d in SOFTNET
        for how, part in (("avg", "mean"), ("max", "max"))
    )
    + f" FROM telemetry WHERE chart_context = 'system.softnet_stat' AND {WORKERS} GROUP BY kd, test_type, run",
    rounds=" ".join(f"{d}_{part}" for d in SOFTNET for part in ("mean", "max")),
)
def softnet_summary(t):
    return interrupts.softnet_summary(t.telemetry)


STATES = [*fixed.CSTATES, fixed.OTHER]


@query(
    "cstate_breakdown",
    ctes=TELEMETRY,
    sql="""SELECT kd, test_type, run, CASE hostname WHEN 'master' THEN 'master' ELSE 'worker' END AS node_type, """
    + ", ".join(
        f"{how}(value) FILTER ({in_column('metric_id', s, fixed.CSTATES)}) AS {s}_{part}"
        for s in STATES
        for how, part in (("avg", "mean"), ("stddev_samp", "std"))
    )
    + """ FROM telemetry WHERE chart_context = 'cpuidle.cpu_cstate_residency_time'
    GROUP BY kd, test_type, run, CASE hostname WHEN 'master' THEN 'master' ELSE 'worker' END""",
    rounds=" ".join(f"{s}_{part}" for s in STATES for part in ("mean", "std")),
)
def cstate_breakdown(t):
    return interrupts.cstate_breakdown(t.telemetry, t.nodes)


@query(
    "irq_cpu_overhead",
    ctes=RATES,
    sql="""SELECT kd, test_type, run, irq_rate, softirq_rate, irq_rate * 0.000075 AS irq_cpu_overhead_pct,
      softirq_rate * 0.000075 AS softirq_cpu_overhead_pct,
      coalesce(irq_rate * 0.000075, 0.0) + coalesce(softirq_rate * 0.000075, 0.0) AS total_cpu_overhead_pct
    FROM irq_runs FULL JOIN soft_totals USING (kd, test_type, run)""",
    rounds="irq_rate softirq_rate",
    irq_cpu_overhead_pct=9, softirq_cpu_overhead_pct=9, total_cpu_overhead_pct=9,
)
def irq_cpu_overhead(t):
    return interrupts.irq_cpu_overhead(interrupts.interrupt_runs(t.telemetry))


@query(
    "throttle_rate", ctes=RATES, sql="SELECT * FROM throttle",
    rounds="throttle_rate_mean throttle_rate_max pct_nonzero",
)
def throttle_rate(t):
    return frequency.throttle_rate(t.telemetry)


@query(
    "all_zero_throttle",
    ctes=RATES,
    sql="""SELECT kd, bool_and(throttle_rate_mean = 0) AS all_zero, count(*) AS n_tests,
      max(throttle_rate_max) AS throttle_max FROM throttle GROUP BY kd""",
    rounds="throttle_max",
)
def all_zero_throttle(t):
    return frequency.all_zero_throttle(frequency.throttle_rate(t.telemetry))


@query(
    "freq_stats", ctes=RATES, sql="SELECT * FROM freq_stats",
    rounds="mean_freq_mhz min_freq_mhz std_freq_mhz freq_cv",
)
def freq_stats(t):
    return frequency.freq_stats(t.telemetry)


@query(
    "freq_below_threshold",
    ctes=RATES,
    sql="""SELECT kd, test_type, run, avg(value) AS mean_freq_mhz, min(value) AS min_freq_mhz,
      avg(CASE WHEN value < 1620 THEN 100.0 ELSE 0.0 END) AS pct_below_threshold,
      count(DISTINCT relative_time) AS n_samples, stddev_pop(value) AS freq_std_mhz,
      CAST(1620 AS DOUBLE) AS threshold_mhz,
      CASE WHEN avg(value) > 0 THEN stddev_pop(value) / avg(value) ELSE 0.0 END AS freq_cv
    FROM freq_rows GROUP BY kd, test_type, run""",
    rounds="mean_freq_mhz min_freq_mhz pct_below_threshold freq_std_mhz freq_cv",
)
def freq_below_threshold(t):
    return frequency.freq_below_threshold(t.telemetry)


@query(
    "thermal_stability",
    ctes=RATES,
    sql="""SELECT k.kd, h.hot AS master_throttle_events, f.m AS worker_mean_freq_mhz,
      f.low AS worker_min_freq_mhz, f.runs AS runs_analysed
    FROM (VALUES ('k0s'), ('k3s'), ('k8s'), ('kubeEdge'), ('openYurt')) AS k(kd)
    LEFT JOIN (SELECT kd, max(throttle_rate_max) AS hot FROM throttle GROUP BY kd) h ON h.kd = k.kd
    LEFT JOIN (SELECT kd, avg(mean_freq_mhz) AS m, min(min_freq_mhz) AS low, count(*) * 5 AS runs
      FROM freq_stats GROUP BY kd) f ON f.kd = k.kd""",
    rounds="master_throttle_events worker_mean_freq_mhz worker_min_freq_mhz",
)
def thermal_stability(t):
    return frequency.thermal_stability(frequency.thermal_levels(t.telemetry), t.published)


def cross_kd(t):
    return statistics.irq_cross_kd(written(interrupts.irq_run_rate(t.telemetry), "irq-runs"))


@query(
    "kruskal_wallis",
    ctes=RATES,
    sql=""", ranked AS (
      SELECT test_type, kd, irq_rate,
        rank() OVER (PARTITION BY test_type ORDER BY round(irq_rate, 9))
          + (count(*) OVER (PARTITION BY test_type, round(irq_rate, 9)) - 1) / 2.0 AS r,
        count(*) OVER (PARTITION BY test_type) AS n,
        count(*) OVER (PARTITION BY test_type, round(irq_rate, 9)) AS ties
      FROM irq_runs
    ), sums AS (
      SELECT test_type, kd, any_value(n) AS n, count(*) AS ng, sum(r) AS rs, avg(irq_rate) AS m,
        stddev_pop(irq_rate) AS s, sum(ties * ties - 1.0) AS tie FROM ranked GROUP BY test_type, kd
    ), tests AS (
      SELECT test_type, (12.0 / (any_value(n) * (any_value(n) + 1.0)) * sum(rs * rs / ng) - 3.0 * (any_value(n) + 1))
        / (1.0 - sum(tie) / (CAST(any_value(n) AS DOUBLE) ** 3 - any_value(n))) AS h FROM sums GROUP BY test_type
    )
    --result
    SELECT s.test_type, s.kd, s.m AS irq_rate_mean, s.s AS irq_rate_std, h AS kruskal_h,
      exp(-h / 2) * (1 + h / 2) AS kruskal_p,
      CASE WHEN exp(-h / 2) * (1 + h / 2) < 0.001 THEN '***' WHEN exp(-h / 2) * (1 + h / 2) < 0.01 THEN '**'
        WHEN exp(-h / 2) * (1 + h / 2) < 0.05 THEN '*' ELSE 'ns' END AS significance
    FROM sums s JOIN tests USING (test_type)""",
    rounds="irq_rate_mean irq_rate_std kruskal_h kruskal_p",
)
def kruskal_wallis(t):
    return cross_kd(t)

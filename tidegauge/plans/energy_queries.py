"""Energy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions import power
from tidegauge.operators import energy, scans
from tidegauge.plans.inputs import TELEMETRY
from tidegauge.plans.registry import query

# the outer join of two separate aggregations, as an independent form
CELLS = TELEMETRY.rstrip() + """, freq AS (
  SELECT kd, test_type, relative_time, hostname, avg(value) AS mean_freq_mhz FROM telemetry
  WHERE chart_context = 'cpufreq.cpufreq' AND metric_id IN ('cpu0', 'cpu1', 'cpu2', 'cpu3')
    AND hostname IN ('node_1', 'node_2', 'node_3')
  GROUP BY ALL
), idle AS (
  SELECT kd, test_type, relative_time, hostname, avg(value) AS mean_idle FROM telemetry
  WHERE chart_context = 'system.cpu' AND metric_id = 'idle'
    AND hostname IN ('node_1', 'node_2', 'node_3')
  GROUP BY ALL
), cells AS (
  SELECT kd, test_type, relative_time, hostname, mean_freq_mhz, mean_idle,
    CASE WHEN mean_idle IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, 1.0 - mean_idle / 400.0)) END AS activity_ratio
  FROM freq LEFT JOIN idle USING (kd, test_type, relative_time, hostname)
), volts AS (
  SELECT *, 0.8 + 0.2 * greatest(0.0, least(1.0, (mean_freq_mhz - 600) / 1200)) AS volt FROM cells
), watts AS (
  SELECT * EXCLUDE (volt), 2.7 + 3.7 / (1.8e9 * 4) * volt * volt * mean_freq_mhz * 1e6 * activity_ratio * 4 AS power_w
  FROM volts
), seconds AS (
  SELECT kd, test_type, relative_time, avg(power_w) AS mean_power_w, avg(mean_freq_mhz) AS mean_freq_mhz
  FROM watts GROUP BY ALL
), steps AS (
  SELECT *, (relative_time - lag(relative_time) OVER w) * (mean_power_w + lag(mean_power_w) OVER w) / 2 AS area
  FROM seconds WINDOW w AS (PARTITION BY kd, test_type ORDER BY relative_time)
), estimates AS (
  SELECT kd, test_type, avg(mean_freq_mhz) AS mean_freq_mhz, stddev_samp(mean_freq_mhz) AS std_freq_mhz,
    avg(mean_power_w) AS mean_power_w, stddev_samp(mean_power_w) AS std_power_w,
    coalesce(sum(area), 0.0) AS energy_j,
    CASE WHEN max(relative_time) > min(relative_time) THEN max(relative_time) - min(relative_time)
      ELSE count(*) END AS duration_s
  FROM steps GROUP BY ALL
)
"""
ESTIMATE = "mean_freq_mhz std_freq_mhz mean_power_w std_power_w energy_j"


@query("energy_estimate", ctes=CELLS, sql="SELECT * FROM estimates", rounds=ESTIMATE)
def energy_estimate(t):
    return energy.energy_estimate(t.telemetry)


CELL_COLUMNS = "kd, test_type, relative_time, hostname, mean_freq_mhz"


@query(
    "agg_ts_host_mean",
    ctes=CELLS,
    sql="""SELECT kd, test_type, relative_time, hostname, mean_freq_mhz, mean_idle
    FROM freq FULL JOIN idle USING (kd, test_type, relative_time, hostname)""",
    rounds="mean_freq_mhz mean_idle",
)
def agg_ts_host_mean(t):
    return energy.host_seconds(t.telemetry)


@query(
    "join_freq_activity",
    ctes=CELLS,
    sql=f"SELECT {CELL_COLUMNS}, activity_ratio FROM cells",
    rounds="mean_freq_mhz activity_ratio",
)
def join_freq_activity(t):
    return energy.with_activity(energy.host_seconds(t.telemetry)).drop("mean_idle")


@query(
    "activity_ratio",
    ctes=TELEMETRY,
    sql="""SELECT kd, test_type, run, relative_time, hostname, value,
      CASE WHEN value > 400 THEN 0.0 WHEN value < 0 THEN 1.0 ELSE 1 - value / 400.0 END AS activity_ratio
    FROM telemetry WHERE chart_context = 'system.cpu' AND metric_id = 'idle'""",
    rounds="activity_ratio",
    digits=9,
)
def activity_ratio(t):
    rows = scans.in_contexts(t.telemetry, [fixed.CTX_CPU]).where(F.col("metric_id") == "idle")
    return rows.select(
        "kd", "test_type", "run", "relative_time", "hostname", "value",
        power.activity(F.col("value")).alias("activity_ratio"),
    )


@query(
    "clip",
    ctes=TELEMETRY,
    sql="""SELECT kd, test_type, run, relative_time, hostname, metric_id, value,
      CASE WHEN value / 100 < 0 THEN 0.0 WHEN value / 100 > 1 THEN 1.0 ELSE value / 100 END AS clipped
    FROM telemetry""",
)
def clip(t):
    return t.telemetry.select(
        "kd", "test_type", "run", "relative_time", "hostname", "metric_id", "value",
        power.clip(F.col("value") / 100).alias("clipped"),
    )


FREQ_ROWS = """SELECT kd, test_type, run, relative_time, hostname, metric_id, value,
      0.8 + 0.2 * CASE WHEN value < 600 THEN 0 WHEN value > 1800 THEN 1 ELSE (value - 600) / 1200 END AS volt
    FROM telemetry WHERE chart_context = 'cpufreq.cpufreq'"""


def freq_rows(t):
    return scans.in_contexts(t.telemetry, [fixed.CTX_FREQ]).select(
        "kd", "test_type", "run", "relative_time", "hostname", "metric_id", "value",
        power.voltage(F.col("value")).alias("volt"),
    )


@query("dvfs_voltage", ctes=TELEMETRY, sql=FREQ_ROWS, rounds="volt", digits=9)
def dvfs_voltage(t):
    return freq_rows(t)


@query(
    "dvfs_power",
    ctes=CELLS,
    sql=f"SELECT {CELL_COLUMNS}, activity_ratio, power_w FROM watts",
    rounds="mean_freq_mhz activity_ratio power_w",
)
def dvfs_power(t):
    cells = energy.with_power(energy.with_activity(energy.host_seconds(t.telemetry)))
    return cells.drop("mean_idle")


@query(
    "agg_cluster_series",
    ctes=CELLS,
    sql="SELECT kd, test_type, relative_time, mean_power_w, mean_freq_mhz FROM seconds",
    rounds="mean_power_w mean_freq_mhz",
)
def agg_cluster_series(t):
    cells = energy.with_power(energy.with_activity(energy.host_seconds(t.telemetry)))
    return energy.cluster_seconds(cells)


@query(
    "trapezoid_energy",
    ctes=CELLS,
    sql="SELECT kd, test_type, energy_j, duration_s FROM estimates",
    rounds="energy_j",
)
def trapezoid_energy(t):
    cells = energy.with_power(energy.with_activity(energy.host_seconds(t.telemetry)))
    return energy.trapezoid_energy(energy.cluster_seconds(cells)).select(
        "kd", "test_type", "energy_j", "duration_s"
    )


EFFICIENCY = "\n    ".join(
    [
        "SELECT kd,",
        *[
            f"any_value({column}) FILTER (test_type = '{test}') AS {name},"
            for test, column, name in [
                ("idle", "mean_power_w", "idle_power_w_mean"),
                ("idle", "std_power_w", "idle_power_w_std"),
                ("idle", "mean_freq_mhz", "idle_freq_mhz_mean"),
                ("cp_heavy_12client", "mean_power_w", "cp_power_w_mean"),
                ("cp_heavy_12client", "std_power_w", "cp_power_w_std"),
                ("cp_heavy_12client", "energy_j", "cp_energy_j_mean"),
                ("cp_heavy_12client", "duration_s", "cp_duration_s_mean"),
                ("cp_heavy_12client", "mean_freq_mhz", "cp_freq_mhz_mean"),
                ("dp_redis_density", "mean_power_w", "dp_power_w_mean"),
                ("dp_redis_density", "std_power_w", "dp_power_w_std"),
                ("dp_redis_density", "mean_freq_mhz", "dp_freq_mhz_mean"),
            ]
        ],
        "any_value(energy_j) FILTER (test_type = 'cp_heavy_12client') / 120 AS energy_per_pod_j,",
        "any_value(mean_power_w) FILTER (test_type = 'cp_heavy_12client')",
        "  - any_value(mean_power_w) FILTER (test_type = 'idle') AS cp_overhead_w,",
        "any_value(energy_j / (duration_s * CASE kd WHEN 'k0s' THEN 16800 WHEN 'k3s' THEN 17200",
        "  WHEN 'k8s' THEN 19000 WHEN 'kubeEdge' THEN 4750 ELSE 18200 END) * 1000)",
        "  FILTER (test_type = 'dp_redis_density') AS energy_per_op_mj",
        "FROM estimates GROUP BY kd",
    ]
)
EFFICIENCY_COLUMNS = (
    "idle_power_w_mean idle_power_w_std idle_freq_mhz_mean cp_power_w_mean cp_power_w_std "
    "cp_energy_j_mean cp_freq_mhz_mean dp_power_w_mean dp_power_w_std dp_freq_mhz_mean "
    "energy_per_pod_j cp_overhead_w energy_per_op_mj"
)


@query("energy_efficiency", ctes=CELLS, sql=EFFICIENCY, rounds=EFFICIENCY_COLUMNS)
def energy_efficiency(t):
    return energy.energy_efficiency(energy.energy_estimate(t.telemetry), t.published)


@query(
    "power_overhead",
    ctes=CELLS,
    sql="""SELECT l.kd, l.mean_power_w - i.mean_power_w AS power_overhead_w
    FROM estimates l JOIN estimates i ON l.kd = i.kd
    WHERE l.test_type = 'cp_heavy_12client' AND i.test_type = 'idle'""",
    rounds="power_overhead_w",
)
def power_overhead(t):
    return energy.power_overhead(energy.energy_estimate(t.telemetry))


@query(
    "completeness_matrix",
    ctes=CELLS,
    sql="""SELECT k.kd, x.test_type, e.kd IS NOT NULL AS has_data,
      CASE WHEN e.kd IS NULL THEN 'N/A' ELSE printf('%.0f', e.mean_freq_mhz) END AS freq_label,
      coalesce(e.mean_power_w, 0.0) AS power_w, coalesce(e.std_power_w, 0.0) AS power_std_w
    FROM (VALUES ('k0s'), ('k3s'), ('k8s'), ('kubeEdge'), ('openYurt')) AS k(kd)
    CROSS JOIN (VALUES ('idle'), ('cp_heavy_12client'), ('dp_redis_density')) AS x(test_type)
    LEFT JOIN estimates e
      ON e.kd = k.kd AND e.test_type = x.test_type""",
    rounds="power_w power_std_w",
)
def completeness_matrix(t):
    return energy.completeness_matrix(energy.energy_estimate(t.telemetry), t.published)

"""Silver layer, classification and overhead queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions import telemetry as cells
from tidegauge.operators import overhead, silver, silver_states
from tidegauge.plans.inputs import TELEMETRY
from tidegauge.plans.registry import query
from tidegauge.session import new_table_path
from tidegauge.sinks import tables as sinks



def _sql_list(values: list[str] | None) -> str:
    return "NULL" if values is None else "[" + ", ".join(f"'{v}'" for v in values) + "]"


_DEFINED = ",\n  ".join(
    f"('{context}', '{name}', '{units}', {_sql_list(dims)}, '{how}')"
    for context, name, units, dims, how in fixed.POD_METRICS
)
DEFINITIONS = f""", definitions(chart_context, metric, metric_units, dims, dim_agg) AS (VALUES
  {_DEFINED}
)"""
PARSED = TELEMETRY.rstrip() + DEFINITIONS + f""", parsed AS (
  SELECT *, regexp_extract(chart_id, '{fixed.CHART_ID_PARTS_PATTERN}', 2) AS pod_uuid,
    regexp_extract(chart_id, '{fixed.CHART_ID_PARTS_PATTERN}', 1) AS qos_class
  FROM telemetry
  WHERE regexp_matches(chart_id, '{fixed.CHART_ID_PARTS_PATTERN}')
)
"""
SILVER = PARSED.rstrip() + """, kept AS (
  SELECT p.*, d.metric, d.metric_units, d.dim_agg FROM parsed p JOIN definitions d
    ON p.chart_context = d.chart_context AND (d.dims IS NULL OR list_contains(d.dims, p.metric_name))
), seconds AS (
  SELECT kd, test_type, run, hostname, pod_uuid, qos_class, metric, metric_units, relative_time,
    CASE dim_agg WHEN 'sum' THEN coalesce(sum(value), 0.0) ELSE max(value) END AS v
  FROM kept
  GROUP BY kd, test_type, run, hostname, pod_uuid, qos_class, metric, metric_units, relative_time, dim_agg
), silver AS (
  SELECT kd, test_type, run, hostname, pod_uuid, qos_class, metric, avg(v) AS value,
    metric_units AS units, count(*) AS n_samples
  FROM seconds GROUP BY kd, test_type, run, hostname, pod_uuid, qos_class, metric, metric_units
)
"""
CLASSIFIED = SILVER.rstrip() + """, inventory AS (
  SELECT kd, hostname, pod_uuid, min(qos_class) AS qos_class,
    list_sort(list(DISTINCT test_type)) AS test_types, count(DISTINCT run) AS n_runs,
    list_sort(list(DISTINCT test_type) FILTER (test_type <> 'idle')) AS found_in_loaded,
    list_sort(list(DISTINCT metric)) AS contexts
  FROM silver GROUP BY kd, hostname, pod_uuid
), idle_pods AS (SELECT DISTINCT kd, pod_uuid FROM silver WHERE test_type = 'idle'
), classification AS (
  SELECT i.kd, i.hostname, i.pod_uuid, i.qos_class,
    CASE WHEN p.pod_uuid IS NOT NULL THEN 'system' ELSE 'workload' END AS role,
    CASE WHEN p.pod_uuid IS NOT NULL THEN 'idle_enumeration' ELSE 'differential_analysis' END AS classification_method,
    p.pod_uuid IS NOT NULL AS found_in_idle,
    coalesce(i.found_in_loaded, CAST([] AS VARCHAR[])) AS found_in_loaded, i.contexts
  FROM inventory i LEFT JOIN idle_pods p ON i.kd = p.kd AND i.pod_uuid = p.pod_uuid
), roles AS (SELECT DISTINCT kd, pod_uuid, role FROM classification
)
"""
IDLE = CLASSIFIED.rstrip() + """, idle_overhead AS (
  SELECT s.kd, hostname, s.pod_uuid, qos_class, metric, units, avg(value) AS mean,
    stddev_samp(value) AS std, count(value) AS n_runs, coalesce(any_value(role), 'unknown') AS role,
    substr(replace(s.pod_uuid, 'pod', ''), 1, 8) AS pod_label
  FROM silver s LEFT JOIN roles r ON s.kd = r.kd AND s.pod_uuid = r.pod_uuid
  WHERE test_type = 'idle'
  GROUP BY s.kd, hostname, s.pod_uuid, qos_class, metric, units
)
"""
LOADED = CLASSIFIED.rstrip() + """, with_role AS (
  SELECT s.*, r.role FROM silver s JOIN roles r ON s.kd = r.kd AND s.pod_uuid = r.pod_uuid
), per_run AS (
  SELECT kd, test_type, role, metric, run, sum(value) AS run_value FROM with_role GROUP BY ALL
), loaded AS (
  SELECT p.kd, p.test_type, p.role, p.metric, avg(run_value) AS mean, stddev_samp(run_value) AS std,
    count(*) AS n_runs, any_value(n.n_pods) AS n_pods
  FROM per_run p JOIN (
    SELECT kd, test_type, role, metric, count(DISTINCT pod_uuid) AS n_pods FROM with_role GROUP BY ALL
  ) n USING (kd, test_type, role, metric)
  GROUP BY p.kd, p.test_type, p.role, p.metric
)
"""


def classified(t):
    return overhead.pod_classification(t.stored_silver)


def idle(t):
    return overhead.idle_overhead(t.stored_silver, classified(t))


def loaded(t):
    return overhead.loaded_overhead(t.stored_silver, classified(t))


@query(
    "parse_chart_id",
    ctes=PARSED,
    sql="SELECT kd, test_type, run, chart_id, pod_uuid, qos_class, value FROM parsed",
)
def parse_chart_id(t):
    return silver.parsed_containers(t.telemetry).select(
        "kd", "test_type", "run", "chart_id", "pod_uuid", "qos_class", "value"
    )


@query(
    "pod_label",
    ctes=PARSED,
    sql="""SELECT kd, pod_uuid, substr(replace(pod_uuid, 'pod', ''), 1, 8) AS pod_label, count(*) AS n
    FROM parsed GROUP BY ALL""",
)
def pod_label(t):
    rows = silver.parsed_containers(t.telemetry)
    return rows.groupBy("kd", "pod_uuid", cells.pod_label(F.col("pod_uuid")).alias("pod_label")).agg(
        F.count("*").alias("n")
    )


@query(
    "join_metric_defs",
    ctes=PARSED,
    sql="""SELECT kd, test_type, run, hostname, relative_time, pod_uuid, chart_context, metric, metric_units,
      dim_agg, value FROM parsed JOIN definitions USING (chart_context)""",
)
def join_metric_defs(t):
    rows = silver.with_metric_definition(silver.parsed_containers(t.telemetry), t.definitions)
    return rows.select(
        "kd", "test_type", "run", "hostname", "relative_time", "pod_uuid", "chart_context",
        "metric", "metric_units", "dim_agg", "value",
    )


@query(
    "semi_dims",
    ctes=SILVER,
    sql="""SELECT kd, test_type, run, hostname, relative_time, pod_uuid, metric, metric_name, value FROM kept""",
)
def semi_dims(t):
    rows = silver.with_metric_definition(silver.parsed_containers(t.telemetry), t.definitions)
    return silver.with_kept_dimensions(rows).select(
        "kd", "test_type", "run", "hostname", "relative_time", "pod_uuid", "metric",
        "metric_name", "value",
    )


@query("silver_pod_metrics", ctes=SILVER, sql="SELECT * FROM silver", rounds="value")
def silver_pod_metrics(t):
    return silver.silver_pod_metrics(t.telemetry, t.definitions)


@query("silver_table", ctes=SILVER, sql="SELECT * FROM silver", rounds="value")
def silver_table(t):
    return silver.silver_table(t.telemetry, t.definitions)


@query("silver_growth", ctes=SILVER, sql="SELECT * FROM silver", rounds="value")
def silver_growth(t):
    """The silver table grown in two steps: idle runs first, then those that came later."""
    runs, states = new_table_path(t.spark, "runs"), new_table_path(t.spark, "silver-states")
    idle_run = F.col("test_type") == "idle"
    for part in (t.telemetry.where(idle_run), t.telemetry.where(~idle_run)):
        sinks.write_runs(part, runs)
        silver_states.grow_silver(t.spark, runs, states, t.definitions)
    return silver_states.silver_of(silver_states.read_states(t.spark, states), t.definitions)


@query(
    "pod_inventory",
    ctes=CLASSIFIED,
    sql="""SELECT kd, hostname, pod_uuid, qos_class, array_to_string(test_types, ',') AS test_types,
      n_runs, array_to_string(contexts, ',') AS contexts FROM inventory""",
)
def pod_inventory(t):
    rows = overhead.pod_inventory(t.silver)
    return rows.withColumn("test_types", F.array_join("test_types", ",")).withColumn(
        "contexts", F.array_join("contexts", ",")
    )


@query(
    "pod_classification",
    ctes=CLASSIFIED,
    sql="""SELECT kd, hostname, pod_uuid, qos_class, role, classification_method, found_in_idle,
      array_to_string(found_in_loaded, ',') AS found_in_loaded, array_to_string(contexts, ',') AS contexts
    FROM classification""",
)
def pod_classification(t):
    return overhead.pod_classification(t.silver).withColumn(
        "found_in_loaded", F.array_join("found_in_loaded", ",")
    ).withColumn("contexts", F.array_join("contexts", ","))


@query(
    "pod_set_difference",
    ctes=SILVER,
    sql="""SELECT DISTINCT kd, pod_uuid FROM silver
    EXCEPT SELECT kd, pod_uuid FROM silver WHERE test_type = 'idle'""",
)
def pod_set_difference(t):
    return overhead.pod_set_difference(t.silver)


@query(
    "join_role",
    ctes=CLASSIFIED,
    sql="""SELECT s.kd, s.test_type, s.run, s.hostname, s.pod_uuid, s.metric, s.value,
      coalesce(r.role, 'unknown') AS role
    FROM silver s LEFT JOIN roles r
      ON s.kd = r.kd AND s.pod_uuid = r.pod_uuid""",
    rounds="value",
)
def join_role(t):
    return overhead.join_role(t.stored_silver, classified(t)).select(
        "kd", "test_type", "run", "hostname", "pod_uuid", "metric", "value", "role"
    )


@query(
    "join_capacity",
    ctes=SILVER,
    sql="""SELECT kd, test_type, run, hostname, pod_uuid, metric, value,
      CASE metric WHEN 'cpu_pct' THEN CASE hostname WHEN 'master' THEN 1200 ELSE 400 END
        ELSE CASE hostname WHEN 'master' THEN 65536 ELSE 8192 END END AS node_capacity,
      value / CASE metric WHEN 'cpu_pct' THEN CASE hostname WHEN 'master' THEN 1200 ELSE 400 END
        ELSE CASE hostname WHEN 'master' THEN 65536 ELSE 8192 END END * 100 AS capacity_pct
    FROM silver WHERE metric IN ('cpu_pct', 'mem_mib')""",
    rounds="value capacity_pct",
)
def join_capacity(t):
    return overhead.capacity_share(t.silver, t.nodes, "value").select(
        "kd", "test_type", "run", "hostname", "pod_uuid", "metric", "value", "node_capacity",
        "capacity_pct",
    )


@query("idle_overhead", ctes=IDLE, sql="SELECT * FROM idle_overhead", rounds="mean std")
def idle_overhead(t):
    return idle(t)


PIVOT_METRICS = fixed.POD_METRIC_NAMES


@query(
    "idle_overhead_pivot",
    ctes=IDLE,
    sql="SELECT kd, hostname, pod_uuid, pod_label, role, qos_class, "
    + ", ".join(f"avg(mean) FILTER (metric = '{m}') AS {m}" for m in PIVOT_METRICS)
    + " FROM idle_overhead GROUP BY kd, hostname, pod_uuid, pod_label, role, qos_class",
    rounds=" ".join(PIVOT_METRICS),
)
def idle_overhead_pivot(t):
    return overhead.idle_overhead_pivot(idle(t))


@query(
    "idle_overhead_totals",
    ctes=IDLE,
    sql="""SELECT kd, metric, coalesce(sum(mean), 0.0) AS total_mean,
      sqrt(coalesce(sum(std * std), 0.0)) AS total_std FROM idle_overhead GROUP BY kd, metric""",
    rounds="total_mean total_std",
)
def idle_overhead_totals(t):
    return overhead.idle_overhead_totals(idle(t))


@query(
    "top_pods",
    ctes=IDLE,
    sql="""SELECT kd, hostname, pod_uuid, qos_class, mean FROM idle_overhead WHERE metric = 'cpu_pct'
    ORDER BY kd, mean DESC, hostname, pod_uuid, qos_class""",
    rounds="mean",
)
def top_pods(t):
    return overhead.top_pods(idle(t), "cpu_pct").select(
        "kd", "hostname", "pod_uuid", "qos_class", "mean"
    )


@query("loaded_overhead", ctes=LOADED, sql="SELECT * FROM loaded", rounds="mean std")
def loaded_overhead(t):
    return loaded(t)


@query(
    "role_counts",
    ctes=CLASSIFIED,
    sql="""SELECT s.kd, s.test_type, count(DISTINCT s.pod_uuid) AS n_pods,
      count(DISTINCT s.pod_uuid) FILTER (r.role = 'system') AS n_system,
      count(DISTINCT s.pod_uuid) FILTER (r.role = 'workload') AS n_workload
    FROM silver s JOIN roles r ON s.kd = r.kd AND s.pod_uuid = r.pod_uuid GROUP BY s.kd, s.test_type""",
)
def role_counts(t):
    return overhead.role_counts(t.stored_silver, classified(t))


@query(
    "orchestration_tax",
    ctes=LOADED,
    sql="""SELECT kd, test_type, metric, mean AS system_overhead,
      CASE metric WHEN 'cpu_pct' THEN 400 ELSE 8192 END AS node_capacity,
      mean / CASE metric WHEN 'cpu_pct' THEN 400 ELSE 8192 END * 100 AS orchestration_tax_pct
    FROM loaded WHERE role = 'system' AND metric IN ('cpu_pct', 'mem_mib')""",
    rounds="system_overhead orchestration_tax_pct",
)
def orchestration_tax(t):
    return overhead.orchestration_tax(loaded(t), t.nodes)


@query(
    "workload_share",
    ctes=LOADED,
    sql="""SELECT s.kd, s.test_type, s.mean AS system_cpu, w.mean AS workload_cpu,
      w.mean / (s.mean + w.mean) * 100 AS workload_share_pct
    FROM loaded s JOIN loaded w ON s.kd = w.kd AND s.test_type = w.test_type AND s.metric = w.metric
    WHERE s.role = 'system' AND w.role = 'workload' AND s.metric = 'cpu_pct'""",
    rounds="system_cpu workload_cpu workload_share_pct",
)
def workload_share(t):
    return overhead.workload_share(loaded(t))


GROWTH_SQL = """SELECT l.kd, l.test_type, l.mean AS system_cpu, i.mean AS idle_mean,
      l.mean / i.mean AS growth_factor
    FROM loaded l JOIN loaded i ON l.kd = i.kd AND l.role = i.role AND l.metric = i.metric
    WHERE l.role = 'system' AND l.metric = 'cpu_pct' AND i.test_type = 'idle'"""


@query("growth_factor", ctes=LOADED, sql=GROWTH_SQL, rounds="system_cpu idle_mean growth_factor")
def growth_factor(t):
    return overhead.growth_factor(loaded(t))

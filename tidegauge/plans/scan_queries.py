"""Sources, sinks and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.operators import ingest, overhead, scans
from tidegauge.plans.inputs import API_LATENCY, METRIC_DOCS, POD_STARTUP, RUN_FILES, TELEMETRY
from tidegauge.plans.pod_queries import CLASSIFIED, LOADED, SILVER, loaded
from tidegauge.plans.registry import query
from tidegauge.session import new_table_path
from tidegauge.sinks import tables as sinks
from tidegauge.sources import benchmarks, documents
from tidegauge.sources import telemetry as sources

RENAMED = (
    "kd, test_type, run, relative_time AS timestamp, hostname, chart_context, chart_id, "
    "chart_family, metric_id AS id, metric_name AS name, value, units"
)
WORKERS = "('node_1', 'node_2', 'node_3')"
CGROUP = "chart_context LIKE 'k8s.cgroup.%'"


def select_renamed(where: str) -> str:
    return f"SELECT {RENAMED} FROM telemetry WHERE {where}"


# --- sources ---------------------------------------------------------------
@query(
    "src_telemetry_run",
    ctes=TELEMETRY,
    sql=select_renamed(
        "kd = 'k0s' AND test_type = 'idle' AND run = 1 "
        "AND chart_context IN ('cpufreq.cpufreq', 'system.cpu')"
    ),
)
def src_telemetry_run(t):
    path = new_table_path(t.spark, "runs")
    sinks.write_runs(t.telemetry, path)
    stored = sources.read_telemetry(t.spark, path)
    return scans.run_rows(stored, "k0s", "idle", 1, [fixed.CTX_FREQ, fixed.CTX_CPU])


@query("src_telemetry_all_runs", ctes=TELEMETRY, sql=select_renamed("true"))
def src_telemetry_all_runs(t):
    return scans.run_rows(t.telemetry)


@query(
    "src_telemetry_pooled",
    ctes=TELEMETRY,
    sql=select_renamed(f"chart_context = 'system.cpu' AND hostname IN {WORKERS}"),
)
def src_telemetry_pooled(t):
    return scans.run_rows(t.telemetry, contexts=[fixed.CTX_CPU], hosts=fixed.WORKERS)


@query(
    "src_cgroup_run",
    ctes=TELEMETRY,
    sql=select_renamed(
        f"{CGROUP} AND kd = 'k0s' AND test_type = 'idle' AND run = 1 AND hostname = 'node_2'"
    ),
)
def src_cgroup_run(t):
    one = scans.container_rows(t.telemetry, kd="k0s", test_type="idle", run=1, hosts=["node_2"])
    return scans.container_order(one)


@query("src_cgroup_all_runs", ctes=TELEMETRY, sql=select_renamed(CGROUP))
def src_cgroup_all_runs(t):
    return scans.container_rows(t.telemetry)


@query("src_pod_startup_csv", ctes=POD_STARTUP, sql="SELECT * FROM pod_startup")
def src_pod_startup_csv(t):
    path = new_table_path(t.spark, "startup")
    rows = t.pod_startup.select(
        F.lit(1).alias("dumn"), F.col("kd").alias("k8s"), "tests",
        F.col("test_number").alias("test-numbers"),
        F.col("number_of_pods").alias("number-of-pods"), "medians", "mins", "maxs",
    )
    sinks.write_result_csv(rows, path)
    return benchmarks.read_pod_startup(t.spark, path).drop("dumn")


@query("src_api_latency_csv", ctes=API_LATENCY, sql="SELECT * FROM api_latency")
def src_api_latency_csv(t):
    path = new_table_path(t.spark, "latency")
    rows = t.api_latency.select(
        F.col("kd").alias("k8s"), "operations", "tests",
        F.col("test_number").alias("test-numbers"), "metrics", "medians", "mins", "maxs",
    )
    sinks.write_result_csv(rows, path)
    return benchmarks.read_api_latency(t.spark, path)


@query(
    "src_idle_series_csv",
    ctes=TELEMETRY,
    sql="""SELECT hostname, value, relative_time AS timestamp, kd || '-idle-' || CAST(run AS VARCHAR) AS run, kd
    FROM telemetry WHERE test_type = 'idle' AND chart_context = 'system.cpu' AND metric_id = 'idle'
      AND kd IN ('k0s', 'k3s')""",
)
def src_idle_series_csv(t):
    path = new_table_path(t.spark, "series")
    rows = idle_series(t).select(
        "hostname", "value", "timestamp", F.concat("run", F.lit("-cpu")).alias("series")
    )
    rows.write.partitionBy("series").option("header", True).csv(path)
    return benchmarks.read_idle_series(t.spark, path)


def idle_series(t):
    """Idle readings as system-level series, one per idle run."""
    return t.telemetry.where(
        (F.col("test_type") == "idle")
        & (F.col("chart_context") == fixed.CTX_CPU)
        & (F.col("metric_id") == "idle")
    ).select(
        "kd", F.format_string("%s-idle-%d", "kd", "run").alias("run"), "hostname", "value",
        F.col("relative_time").alias("timestamp"),
    )


@query(
    "src_silver",
    ctes=SILVER,
    sql="""SELECT *, 'all' AS scope FROM silver
    UNION ALL SELECT *, 'k0s' FROM silver WHERE kd = 'k0s'""",
    rounds="value",
)
def src_silver(t):
    # the stored table whole, and by a predicate that chooses one folder
    path = new_table_path(t.spark, "silver")
    sinks.write_silver(t.silver, path)
    stored = sources.read_silver(t.spark, path)
    one = stored.where(F.col("kd") == "k0s")
    return stored.withColumn("scope", F.lit("all")).unionByName(
        one.withColumn("scope", F.lit("k0s"))
    )


@query(
    "src_classification_json",
    ctes=CLASSIFIED,
    sql="""SELECT pod_uuid, arg_max(kd, kd || '/' || hostname) AS kd,
      arg_max(hostname, kd || '/' || hostname) AS hostname, arg_max(role, kd || '/' || hostname) AS role
    FROM classification GROUP BY pod_uuid""",
)
def src_classification_json(t):
    path = new_table_path(t.spark, "classes")
    sinks.write_json(overhead.pod_classification(t.silver), path)
    stored = sources.read_classification(t.spark, path)
    return sources.classification_by_pod(stored).select("pod_uuid", "kd", "hostname", "role")


@query(
    "src_result_csv",
    ctes=LOADED,
    sql="SELECT kd, test_type, role, metric, mean, std, n_runs, n_pods FROM loaded",
    rounds="mean std",
)
def src_result_csv(t):
    path = new_table_path(t.spark, "loaded")
    result = loaded(t)
    sinks.write_result_csv(result, path)
    schema = ", ".join(f"{name} {kind}" for name, kind in result.dtypes)
    return sources.read_result_csv(t.spark, path, schema)


@query(
    "src_registry_json",
    ctes=RUN_FILES,
    sql="SELECT *, end_ts - start_ts AS duration_s FROM run_registry",
)
def src_registry_json(t):
    path = new_table_path(t.spark, "registry")
    sinks.write_json(ingest.run_registry(t.run_files), path)
    return documents.read_registry(t.spark, path)


@query(
    "src_metric_docs",
    ctes=METRIC_DOCS,
    sql="""SELECT hostname, timestamp, chart_context, chart_id, chart_family, id, name, value, units
    FROM metric_docs WHERE tag = 'k0s-idle-1.' AND timestamp BETWEEN 1704153600 AND 1706486400""",
)
def src_metric_docs(t):
    path = new_table_path(t.spark, "documents")
    sinks.write_documents(t.documents, path)
    stored = documents.read_stored_documents(t.spark, path, 1704153600, 1706486400)
    return documents.documents_of_tag(stored, "k0s-idle-1.", 1704153600, 1706486400)


@query("src_run_logs", ctes=RUN_FILES, sql="SELECT kd, test_type, run_dir, file_name, text FROM files")
def src_run_logs(t):
    path = new_table_path(t.spark, "logs")
    rows = t.run_files.select("kd", "test_type", "run_dir", "file_name", "text")
    (
        rows.write.option("lineSep", "\u0000")
        .partitionBy("kd", "test_type", "run_dir", "file_name")
        .text(path)
    )
    # the writer ends every record with the separator
    return documents.read_run_logs(t.spark, path).withColumn(
        "text", F.rtrim(F.col("text"), F.lit("\u0000"))
    )


# --- sinks: write, read back, compare --------------------------------------
@query(
    "sink_run_parquet",
    ctes=TELEMETRY,
    sql="""SELECT kd, test_type, run, count(*) AS n_rows, sum(value) AS total,
      max(relative_time) AS last_second FROM telemetry GROUP BY kd, test_type, run""",
    rounds="total",
)
def sink_run_parquet(t):
    path = new_table_path(t.spark, "runs")
    first = t.telemetry.where(F.col("test_type") != "idle")
    sinks.write_runs(first, path)
    existing = sources.read_telemetry(t.spark, path)
    sinks.write_runs(t.telemetry, path, existing=existing)
    stored = sources.read_telemetry(t.spark, path)
    return stored.groupBy(*scans.RUN).agg(
        F.count("*").alias("n_rows"), F.sum("value").alias("total"),
        F.max("relative_time").alias("last_second"),
    )


@query("sink_silver_parquet", ctes=SILVER, sql="SELECT * FROM silver", rounds="value")
def sink_silver_parquet(t):
    path = new_table_path(t.spark, "silver")
    sinks.write_silver(t.silver, path)
    return sources.read_silver(t.spark, path)


@query(
    "sink_result_csv",
    ctes=SILVER,
    sql="""SELECT kd, metric, avg(value) AS mean_value, count(*) AS n FROM silver GROUP BY kd, metric""",
    rounds="mean_value",
    digits=9,
)
def sink_result_csv(t):
    path = new_table_path(t.spark, "result")
    result = t.silver.groupBy("kd", "metric").agg(
        F.avg("value").alias("mean_value"), F.count("*").alias("n")
    )
    sinks.write_result_csv(result, path)
    return sources.read_result_csv(t.spark, path, "kd string, metric string, mean_value double, n bigint")


@query(
    "sink_result_csv_fixed",
    ctes=SILVER,
    sql="""SELECT kd, test_type, run, hostname, pod_uuid, metric, printf('%.6f', least_value) AS least_value,
      printf('%.6f', least_value * 0.123456789) AS share
    FROM (SELECT kd, test_type, run, hostname, pod_uuid, metric, min(value) AS least_value
      FROM silver GROUP BY ALL)""",
)
def sink_result_csv_fixed(t):
    # least values are the same bits in every engine, so the text is compared as text
    path = new_table_path(t.spark, "fixed")
    keys = ["kd", "test_type", "run", "hostname", "pod_uuid", "metric"]
    least = t.silver.groupBy(*keys).agg(F.min("value").alias("least_value"))
    result = least.withColumn("share", F.col("least_value") * 0.123456789)
    sinks.write_result_csv_fixed(result, path)
    kinds = dict(result.dtypes) | {"least_value": "string", "share": "string"}
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    return sources.read_result_csv(t.spark, path, schema)


@query(
    "sink_classification_json",
    ctes=CLASSIFIED,
    sql="""SELECT kd, hostname, pod_uuid, qos_class, role, classification_method, found_in_idle,
      array_to_string(found_in_loaded, ',') AS found_in_loaded, array_to_string(contexts, ',') AS contexts
    FROM classification""",
)
def sink_classification_json(t):
    path = new_table_path(t.spark, "classes")
    sinks.write_json(overhead.pod_classification(t.silver), path)
    stored = sources.read_classification(t.spark, path)
    return stored.withColumn("found_in_loaded", F.array_join("found_in_loaded", ",")).withColumn(
        "contexts", F.array_join("contexts", ",")
    )


# --- filters and projections ------------------------------------------------
@query(
    "filter_context_in",
    ctes=TELEMETRY,
    sql="SELECT * FROM telemetry WHERE chart_context IN ('cpufreq.cpufreq', 'system.cpu')",
)
def filter_context_in(t):
    return scans.in_contexts(t.telemetry, [fixed.CTX_FREQ, fixed.CTX_CPU])


@query(
    "filter_host_in",
    ctes=TELEMETRY,
    sql=f"SELECT * FROM telemetry WHERE hostname IN {WORKERS}",
)
def filter_host_in(t):
    return scans.on_hosts(t.telemetry, fixed.WORKERS)


@query(
    "filter_context_regex",
    ctes=TELEMETRY,
    sql="""SELECT * FROM telemetry WHERE split_part(chart_context, '.', 1) IN ('system', 'disk', 'disk_ext',
      'net', 'ip', 'ipv4', 'ipv6', 'mem', 'cpufreq', 'cpu', 'cpuidle', 'pci', 'netfilter')
      AND contains(chart_context, '.')""",
)
def filter_context_regex(t):
    return scans.system_contexts(t.telemetry)


@query(
    "filter_core_ids",
    ctes=TELEMETRY,
    sql="SELECT * FROM telemetry WHERE metric_id IN ('cpu0', 'cpu1', 'cpu2', 'cpu3')",
)
def filter_core_ids(t):
    return scans.worker_cores(t.telemetry)


@query("project_rename", ctes=TELEMETRY, sql=select_renamed("true"))
def project_rename(t):
    return scans.renamed(t.telemetry)


@query(
    "sort_run",
    ctes=TELEMETRY,
    sql="SELECT * FROM telemetry ORDER BY kd, test_type, run, relative_time, hostname, chart_context, metric_id",
)
def sort_run(t):
    return scans.sorted_runs(t.telemetry)


@query("sort_cgroup", ctes=TELEMETRY, sql=select_renamed(CGROUP) + " ORDER BY timestamp, hostname, chart_context, name")
def sort_cgroup(t):
    return scans.container_order(scans.container_rows(t.telemetry))


@query(
    "union_runs",
    ctes=TELEMETRY,
    sql="""SELECT kd, test_type, run, relative_time, hostname, metric_id, value FROM telemetry
    WHERE test_type = 'idle'
    UNION ALL
    SELECT kd, test_type, run, relative_time, hostname, metric_id, value FROM telemetry
    WHERE test_type = 'cp_heavy_12client'
    UNION ALL
    SELECT kd, test_type, run, relative_time, hostname, metric_id, value FROM telemetry
    WHERE test_type = 'dp_redis_density'""",
)
def union_runs(t):
    columns = ["kd", "test_type", "run", "relative_time", "hostname", "metric_id", "value"]
    parts = [t.telemetry.where(F.col("test_type") == test) for test in fixed.TEST_TYPES]
    return scans.union_runs(*[part.select(*columns) for part in parts])

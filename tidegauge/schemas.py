"""Declared schemas of every input and of the tables handed between jobs."""

from __future__ import annotations

TELEMETRY = (
    "relative_time bigint, hostname string, chart_context string, chart_id string, "
    "chart_family string, metric_id string, metric_name string, value double, units string"
)
RUN_KEY = "kd string, test_type string, run int"
TELEMETRY_PARTITIONED = f"{TELEMETRY}, {RUN_KEY}"

SILVER_COLUMNS = [
    "kd", "test_type", "run", "hostname", "pod_uuid",
    "qos_class", "metric", "value", "units", "n_samples",
]
SILVER = (
    "test_type string, run int, hostname string, pod_uuid string, qos_class string, "
    "metric string, value double, units string, n_samples bigint, kd string"
)

# the header names differ from ours, so the declared names are the final ones
POD_STARTUP_CSV = (
    "dumn int, k8s string, tests string, `test-numbers` int, `number-of-pods` int, "
    "medians double, mins double, maxs double"
)
API_LATENCY_CSV = (
    "k8s string, operations string, tests string, `test-numbers` int, metrics string, "
    "medians double, mins double, maxs double"
)
CSV_RENAMES = {"k8s": "kd", "test-numbers": "test_number", "number-of-pods": "number_of_pods"}
SYSTEM_SERIES_CSV = "hostname string, value double, timestamp bigint"

CLASSIFICATION = (
    "kd string, hostname string, pod_uuid string, qos_class string, role string, "
    "classification_method string, found_in_idle boolean, "
    "found_in_loaded array<string>, contexts array<string>"
)
REGISTRY = (
    "kd string, test_type string, run_dir string, run_num int, tag string, "
    "start_ts bigint, end_ts bigint, duration_s bigint"
)
DOCUMENTS = (
    "labels struct<tag: string>, timestamp bigint, hostname string, chart_context string, "
    "chart_id string, chart_family string, id string, name string, units string, value double"
)
VERDICT = (
    "proposition_id string, direction string, hypothesis string, supported boolean, "
    "strength string, verdict string, evidence array<string>, statistics map<string, double>"
)

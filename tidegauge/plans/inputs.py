"""The given tables in the shapes that the operators read.

Each shape is a projection of one given table, so every query grows with it.
The SQL beside each is the same projection for the check.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions.telemetry import epoch_seconds
from tidegauge.operators.silver import silver_table
from tidegauge.session import fixed_table, written

TABLES = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_returnflag string"
    ),
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double",
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    ),
}

# number, context, metric, units, offset, scale
CATALOGUE = [
    (0, "cpufreq.cpufreq", "cpu0", "MHz", 600.0, 24.0),
    (1, "cpufreq.cpufreq", "cpu1", "MHz", 600.0, 24.0),
    (2, "cpufreq.cpufreq", "cpu2", "MHz", 600.0, 24.0),
    (3, "cpufreq.cpufreq", "cpu3", "MHz", 600.0, 24.0),
    (4, "system.cpu", "idle", "percentage", 40.0, 1.0),
    (5, "system.cpu", "idle", "percentage", 40.0, 1.0),
    (6, "system.cpu", "user", "percentage", 0.0, 1.0),
    (7, "system.cpu", "system", "percentage", 0.0, 0.5),
    (8, "system.interrupts", "irq_timer", "interrupts/s", 100.0, 10.0),
    (9, "system.interrupts", "irq_eth0", "interrupts/s", 0.0, 40.0),
    (10, "system.interrupts", "irq_mmc0", "interrupts/s", 0.0, 2.0),
    (11, "system.softirqs", "NET_RX", "softirqs/s", 10.0, 20.0),
    (12, "system.softirqs", "SCHED", "softirqs/s", 50.0, 2.0),
    (13, "system.softirqs", "TIMER", "softirqs/s", 30.0, 1.0),
    (14, "system.softirqs", "RCU", "softirqs/s", 60.0, 4.0),
    (15, "cpu.core_throttling", "cpu0", "events/s", -40.0, 1.0),
    (16, "cpu.core_throttling", "cpu1", "events/s", -40.0, 1.0),
    (17, "system.softnet_stat", "processed", "events/s", 5.0, 8.0),
    (18, "system.softnet_stat", "dropped", "events/s", 0.0, 0.0),
    (19, "cpuidle.cpu_cstate_residency_time", "active", "percentage", 0.0, 1.0),
    (20, "k8s.cgroup.cpu", "user", "percentage", 0.0, 0.2),
    (21, "k8s.cgroup.cpu", "system", "percentage", 0.0, 0.1),
    (22, "k8s.cgroup.mem_usage", "ram", "MiB", 4.0, 0.5),
    (23, "k8s.cgroup.mem_usage", "swap", "MiB", 0.0, 0.0),
    (24, "k8s.cgroup.mem_utilization", "utilization", "percentage", 0.0, 0.2),
    (25, "k8s.cgroup.net_net", "received", "kilobits/s", 0.0, 1.0),
    (26, "k8s.cgroup.net_net", "sent", "kilobits/s", 0.0, -1.0),
    (27, "k8s.cgroup.io", "read", "KiB/s", 0.0, 1.0),
    (28, "k8s.cgroup.io", "write", "KiB/s", 0.0, -3.0),
    (29, "k8s.cgroup.pgfaults", "pgfault", "faults/s", 0.0, 0.1),
    (30, "k8s.cgroup.throttled", "throttled", "events/s", 0.0, 0.0),
    (31, "k8s.cgroup.cpu_some_pressure", "some 10", "percentage", 0.0, 0.1),
]
CATALOGUE_SCHEMA = (
    "m int, chart_context string, metric_id string, units string, offset double, scale double"
)


def _kd(column: str) -> str:
    """CASE that spreads a key over the five systems (valid in both dialects)."""
    names = fixed.KD_ORDER
    arms = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names[:-1]))
    return f"CASE {column} % 5 {arms} ELSE '{names[-1]}' END"


HOST = "CASE {c} % 4 WHEN 0 THEN 'master' WHEN 1 THEN 'node_1' WHEN 2 THEN 'node_2' ELSE 'node_3' END"

TELEMETRY_BASE = f"""
    {_kd("l_suppkey")} AS kd,
    CASE l_returnflag WHEN 'N' THEN 'idle' WHEN 'R' THEN 'cp_heavy_12client' ELSE 'dp_redis_density' END AS test_type,
    CAST(1 + l_orderkey % 5 AS INT) AS run,
    CAST(5 * (CAST(floor(l_partkey / 4) AS BIGINT) % 12) AS BIGINT) AS relative_time,
    {HOST.format(c="l_partkey")} AS hostname,
    CAST((CAST(floor(l_orderkey / 5) AS BIGINT) + l_linenumber) % 32 AS INT) AS m,
    CASE l_returnflag WHEN 'N' THEN CAST(l_quantity AS BIGINT) % 4 ELSE CAST(l_quantity AS BIGINT) % 9 END AS pod,
    l_linenumber % 2 AS container, l_quantity AS q"""

CHART_ID = """CASE WHEN chart_context LIKE 'k8s.cgroup.%'
    THEN 'cgroup_k8s_kubepods_' || CASE WHEN pod % 2 = 0 THEN 'burstable' ELSE 'besteffort' END
      || '_pod0000000' || CAST(pod AS STRING) || '-0000-4000-8000-00000000000' || CAST(pod AS STRING)
      || '_c0ffee' || CAST(container AS STRING) || '.' || replace(chart_context, 'k8s.cgroup.', '')
    ELSE chart_context END"""

READING = """CAST(CASE WHEN chart_context = 'cpu.core_throttling'
    THEN greatest(offset_ + scale * q, 0.0) ELSE offset_ + scale * q END AS DOUBLE)"""

_VALUES = ",\n    ".join(
    "({}, '{}', '{}', '{}', {}, {})".format(*row) for row in CATALOGUE
)

TELEMETRY = f"""WITH base AS (SELECT {TELEMETRY_BASE}
  FROM lineitem
), cat(m, chart_context, metric_id, units, offset_, scale) AS (VALUES
    {_VALUES}
), telemetry AS (
  SELECT kd, test_type, run, relative_time, hostname, chart_context, {CHART_ID} AS chart_id,
    split_part(chart_context, '.', 1) AS chart_family, metric_id, metric_id AS metric_name,
    {READING} AS value, units
  FROM base JOIN cat ON base.m = cat.m
)
"""

TEST = "CASE o_orderkey % 3 WHEN 0 THEN 'cp_light_1client' WHEN 1 THEN 'cp_heavy_8client' ELSE 'cp_heavy_12client' END"

POD_STARTUP_COLUMNS = f"""{_kd("o_custkey")} AS kd, {TEST} AS tests,
    CAST(1 + o_orderkey % 5 AS INT) AS test_number,
    CAST((CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 16 ELSE 24 END)
      * (1 + 4 * (CAST(floor(o_orderkey / 15) AS BIGINT) % 2)) AS INT) AS number_of_pods,
    CAST(1000 * floor(o_totalprice / 20000) * (CASE o_custkey % 5 WHEN 3 THEN 2 ELSE 1 END) AS DOUBLE) AS medians,
    CAST(500 * floor(o_totalprice / 20000) AS DOUBLE) AS mins,
    CAST(3000 * floor(o_totalprice / 20000) AS DOUBLE) AS maxs"""

API_LATENCY_COLUMNS = f"""{_kd("o_custkey")} AS kd,
    CASE CAST(floor(o_orderkey / 15) AS BIGINT) % 4 WHEN 0 THEN 'namespace' WHEN 1 THEN 'deployment'
      WHEN 2 THEN 'pod' ELSE 'service' END AS operations,
    {TEST} AS tests, CAST(1 + o_orderkey % 5 AS INT) AS test_number,
    CASE CAST(floor(o_orderkey / 60) AS BIGINT) % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'get'
      WHEN 2 THEN 'list' WHEN 3 THEN 'update' ELSE 'delete' END AS metrics,
    CAST(o_totalprice / 1000 AS DOUBLE) AS medians, CAST(o_totalprice / 2000 AS DOUBLE) AS mins,
    CAST(o_totalprice / 500 AS DOUBLE) AS maxs"""

RUN_OF_EVENT = "CAST(1 + event_id % 5 AS INT)"
DOC_TAG = f"""CASE user_id % 5 WHEN 0 THEN 'k0s-idle-' || CAST({RUN_OF_EVENT} AS STRING) || '.'
      WHEN 1 THEN 'idle-' || CAST({RUN_OF_EVENT} AS STRING)
      WHEN 2 THEN 'k8s-idle-' || CAST({RUN_OF_EVENT} AS STRING)
      WHEN 3 THEN 'kubeEdge-idle-' || CAST({RUN_OF_EVENT} AS STRING) || '.'
      ELSE 'unmatched' END"""

DOC_COLUMNS = f"""{_kd("user_id")} AS kd, {RUN_OF_EVENT} AS run, {DOC_TAG} AS tag,
    {HOST.format(c="user_id")} AS hostname, 'system.' || event_type AS chart_context,
    'system.' || event_type AS chart_id, 'system' AS chart_family, event_type AS id,
    event_type AS name, value, 'events/s' AS units"""

POD_STARTUP = f"WITH pod_startup AS (SELECT {POD_STARTUP_COLUMNS}\n  FROM orders\n)\n"
API_LATENCY = f"WITH api_latency AS (SELECT {API_LATENCY_COLUMNS}\n  FROM orders\n)\n"
METRIC_DOCS = f"""WITH metric_docs AS (SELECT {DOC_COLUMNS},
    CAST(floor(extract(epoch FROM ts)) AS BIGINT) AS timestamp
  FROM events
)
"""
# one log per (kd, run), and the two marker files; k8s has an empty start marker (0)
RUN_FILES = f"""{METRIC_DOCS.rstrip()}, spans AS (
  SELECT kd, run, min(timestamp) + 86400 * run AS first_s, max(timestamp) - 86400 * run AS last_s
  FROM metric_docs GROUP BY kd, run
), files AS (
  SELECT kd, 'idle' AS test_type, 'idle-' || CAST(run AS VARCHAR) AS run_dir, file_name,
    CASE file_name
      WHEN 'ansible_output_1.txt' THEN 'TASK [change the tag to ' || kd || CASE kd WHEN 'openYurt' THEN '-cp-' ELSE '-idle-' END
        || CAST(run AS VARCHAR) || ',**] ok' || chr(10) || '"msg": "' || CAST(first_s + 1 AS VARCHAR) || ' - ' || CAST(last_s + 1 AS VARCHAR) || '"'
      WHEN 'tmp-before.txt' THEN CASE WHEN kd = 'k8s' THEN '0' ELSE CAST(first_s AS VARCHAR) END || chr(10)
      ELSE ' ' || CAST(last_s AS VARCHAR) || chr(10) END AS text
  FROM spans CROSS JOIN (VALUES ('ansible_output_1.txt'), ('tmp-before.txt'), ('tmp-after.txt')) AS f(file_name)
  WHERE NOT (kd = 'openYurt' AND file_name <> 'ansible_output_1.txt')
    AND NOT (kd = 'openYurt' AND run = 5)
), run_registry AS (
  SELECT kd, 'idle' AS test_type, 'idle-' || CAST(run AS VARCHAR) AS run_dir, run AS run_num,
    kd || CASE kd WHEN 'openYurt' THEN '-cp-' ELSE '-idle-' END || CAST(run AS VARCHAR) AS tag,
    CASE WHEN kd IN ('k8s', 'openYurt') THEN first_s + 1 ELSE first_s END AS start_ts,
    CASE WHEN kd = 'openYurt' THEN last_s + 1 ELSE last_s END AS end_ts
  FROM spans WHERE NOT (kd = 'openYurt' AND run = 5)
)
"""


class Inputs:
    """The given tables of one folder, in the shapes of the operators."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

        self._written: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A reduced table that several branches of one query read: written once."""
        if name not in self._written:
            self._written[name] = written(build(), name)
        return self._written[name]

    def table(self, name: str) -> DataFrame:
        """The columns of a given table that the shapes use, with declared types."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def telemetry(self) -> DataFrame:
        """Long-format telemetry from ``lineitem`` (32 fixed metrics, broadcast)."""
        catalogue = fixed_table(self.spark, CATALOGUE, CATALOGUE_SCHEMA)
        base = self.table("lineitem").selectExpr(*_split(TELEMETRY_BASE))
        catalogue = catalogue.withColumnRenamed("offset", "offset_")
        return base.join(F.broadcast(catalogue), "m").selectExpr(
            "kd", "test_type", "run", "relative_time", "hostname", "chart_context",
            f"{CHART_ID} AS chart_id", "split_part(chart_context, '.', 1) AS chart_family",
            "metric_id", "metric_id AS metric_name", f"{READING} AS value", "units",
        )

    @cached_property
    def pod_startup(self) -> DataFrame:
        """Pod start-up latency from ``orders``."""
        return self.table("orders").selectExpr(*_split(POD_STARTUP_COLUMNS))

    @cached_property
    def api_latency(self) -> DataFrame:
        """API latency from ``orders``."""
        return self.table("orders").selectExpr(*_split(API_LATENCY_COLUMNS))

    @cached_property
    def metric_docs(self) -> DataFrame:
        """Raw documents from ``events``, with kd and run beside them."""
        return self.table("events").select(
            *[F.expr(part) for part in _split(DOC_COLUMNS)], epoch_seconds("ts").alias("timestamp")
        )

    @cached_property
    def documents(self) -> DataFrame:
        """The documents alone, tag nested as stored."""
        return self.metric_docs.select(
            F.struct("tag").alias("labels"), *fixed.DOCUMENT_FIELDS
        )

    @cached_property
    def run_files(self) -> DataFrame:
        """Run logs and marker files; the spans come from the documents."""
        spans = self.metric_docs.groupBy("kd", "run").agg(
            (F.min("timestamp") + 86400 * F.col("run")).alias("first_s"),
            (F.max("timestamp") - 86400 * F.col("run")).alias("last_s"),
        )
        run_dir = F.concat(F.lit("idle-"), F.col("run").cast("string"))
        unmarked = F.col("kd") == "openYurt"
        log = F.format_string(
            'TASK [change the tag to %s-%s-%d,**] ok\n"msg": "%d - %d"',
            "kd", F.when(unmarked, "cp").otherwise("idle"), "run", F.col("first_s") + 1, F.col("last_s") + 1,
        )
        start = F.when(F.col("kd") == "k8s", F.lit(0)).otherwise(F.col("first_s"))
        texts = {
            "ansible_output_1.txt": log,
            fixed.START_MARKER: F.format_string("%d\n", start),
            fixed.END_MARKER: F.format_string(" %d\n", "last_s"),
        }
        entries = F.array(
            *[F.struct(F.lit(k).alias("file_name"), v.alias("text")) for k, v in texts.items()]
        )
        return (
            spans.where(~(unmarked & (F.col("run") == 5)))
            .select("kd", F.lit("idle").alias("test_type"), run_dir.alias("run_dir"),
                    F.inline(entries))
            .where(~unmarked | F.col("file_name").startswith(fixed.LOG_PREFIX))
        )

    @cached_property
    def published(self) -> DataFrame:
        """Published values per system."""
        return fixed.published(self.spark)

    @cached_property
    def nodes(self) -> DataFrame:
        """Hosts with their capacity."""
        return fixed.nodes(self.spark)

    @cached_property
    def definitions(self) -> DataFrame:
        """Container metric definitions."""
        return fixed.pod_metrics(self.spark)

    @cached_property
    def silver(self) -> DataFrame:
        """Silver table as a plan, for queries that read it once."""
        return silver_table(self.telemetry, self.definitions)

    @property
    def stored_silver(self) -> DataFrame:
        """Silver table written once, for queries with several branches on it."""
        return self.once("silver", lambda: self.silver)


def _split(columns: str) -> list[str]:
    """Split a select list at its top-level commas."""
    parts, depth, current = [], 0, ""
    for char in columns:
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += char
    return [*parts, current.strip()]

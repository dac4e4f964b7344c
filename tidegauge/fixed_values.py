"""Published values the analyses depend on.

Everything here is a fixed value: hardware data, published measurements,
metric definitions, patterns, labels and decision thresholds.  They must equal
the published ones for the results to agree, so they are stated as plain text.
The largest table has about a dozen rows, which bounds every broadcast of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.session import fixed_table

# --- fixed values: systems and workloads -----------------------------------
KD_ORDER = ["k0s", "k3s", "k8s", "kubeEdge", "openYurt"]
KD_LABELS = {
    "k0s": "k0s",
    "k3s": "k3s",
    "k8s": "k8s",
    "kubeEdge": "KubeEdge",
    "openYurt": "OpenYurt",
}
TEST_TYPES = ["idle", "cp_heavy_12client", "dp_redis_density"]
TEST_LABELS = {
    "idle": "Idle",
    "cp_heavy_12client": "CP Heavy\n(12 clients)",
    "dp_redis_density": "DP Redis\nDensity",
}
QOS_LABELS = {
    "burstable": "Burstable",
    "besteffort": "BestEffort",
}
RUNS_PER_TEST = 5
LIGHTWEIGHT_KDS = ["k0s", "k3s"]
HEAVY_KDS = ["k8s", "kubeEdge", "openYurt"]

# --- fixed values: nodes ---------------------------------------------------
# hostname, node type, cores, RAM in MiB
NODES = [
    ("master", "master", 12, 65536),
    ("node_1", "worker", 4, 8192),
    ("node_2", "worker", 4, 8192),
    ("node_3", "worker", 4, 8192),
]
MASTER = "master"
WORKERS = ["node_1", "node_2", "node_3"]
WORKER_CORES = ["cpu0", "cpu1", "cpu2", "cpu3"]
TAX_NODE = "node_2"

# --- fixed values: worker power model --------------------------------------
FREQ_MIN_MHZ = 600.0
FREQ_MAX_MHZ = 1800.0
VOLT_MIN = 0.8
VOLT_MAX = 1.0
POWER_STATIC_W = 2.7
POWER_FULL_W = 6.4
CORES = 4
IDLE_FULL_SCALE = 400.0
ACTIVITY_WHEN_UNKNOWN = 0.5

# --- fixed values: published measurements per system -----------------------
# kd, security %, idle CPU %, idle RAM MiB, set-up hours, data-plane ops/s,
# data-plane latency ms, pod start-up ms at 120 pods
PUBLISHED = [
    ("k0s", 23.69, 4.0, 370.0, 3.0, 16800.0, 11.9, 7500.0),
    ("k3s", 7.21, 1.5, 348.0, 2.0, 17200.0, 11.6, 6800.0),
    ("k8s", 55.0, 5.2, 415.0, 5.0, 19000.0, 10.5, 7200.0),
    ("kubeEdge", 55.0, 6.8, 440.0, 14.0, 4750.0, 42.1, 30000.0),
    ("openYurt", 55.0, 5.6, 425.0, 14.0, 18200.0, 11.0, 7800.0),
]
PUBLISHED_SCHEMA = (
    "kd string, security_pct double, idle_cpu_pct double, idle_ram_mib double, "
    "setup_hours double, dp_ops double, dp_latency_ms double, startup_120_ms double"
)
PODS_AT_SCALE = 120

# --- fixed values: metric contexts -----------------------------------------
CTX_FREQ = "cpufreq.cpufreq"
CTX_CPU = "system.cpu"
CTX_IRQ = "system.interrupts"
CTX_SOFTIRQ = "system.softirqs"
CTX_SOFTNET = "system.softnet_stat"
CTX_THROTTLE = "cpu.core_throttling"
CTX_CSTATE = "cpuidle.cpu_cstate_residency_time"
CGROUP_PREFIX = "k8s.cgroup."
# the published form, class and pod apart; and the two in one group, cut apart later
CHART_ID_PARTS_PATTERN = r"^cgroup_k8s_kubepods_(\w+)_(pod[0-9a-f-]+)_[0-9a-f]+\..+"
CHART_ID_PATTERN = r"^cgroup_k8s_kubepods_(\w+_pod[0-9a-f-]+)_[0-9a-f]+\..+"
SYSTEM_CONTEXT_PATTERN = (
    r"^(system\.|disk\.|disk_ext\.|net\.|ip\.|ipv4\.|ipv6\."
    r"|mem\.|cpufreq\.|cpu\.|cpuidle\.|pci\.|netfilter\.)"
)
SOFTIRQ_CATEGORIES = [
    "BLOCK", "HI", "HRTIMER", "IRQ_POLL", "NET_RX", "NET_TX", "RCU", "SCHED", "TASKLET", "TIMER",
]
# where unlisted categories, dimensions and states are put in wide tables
OTHER = "other"
SOFTNET_DIMENSIONS = ["dropped", "flow_limit_count", "processed", "received_rps", "squeezed"]
CSTATES = ["active", "c1_acpi", "c2_acpi", "c3_acpi", "poll"]

# context, short name, units, dimension names kept (None keeps all), combination
POD_METRICS = [
    ("k8s.cgroup.cpu", "cpu_pct", "%", ["user", "system"], "sum"),
    ("k8s.cgroup.mem_usage", "mem_mib", "MiB", ["ram"], "max"),
    ("k8s.cgroup.mem_utilization", "mem_util_pct", "%", None, "max"),
    ("k8s.cgroup.net_net", "net_kbps", "kbit/s", ["received", "sent"], "sum"),
    ("k8s.cgroup.io", "io_kibs", "KiB/s", ["read", "write"], "sum"),
    ("k8s.cgroup.pgfaults", "pgfaults", "faults/s", ["pgfault", "pgmajfault"], "sum"),
    ("k8s.cgroup.throttled", "throttled", "events/s", ["throttled"], "sum"),
    ("k8s.cgroup.cpu_some_pressure", "cpu_pressure", "%", ["some 10"], "max"),
    ("k8s.cgroup.memory_some_pressure", "mem_pressure", "%", ["some 10"], "max"),
]
POD_METRICS_SCHEMA = (
    "chart_context string, metric string, metric_units string, dims array<string>, dim_agg string"
)
POD_METRIC_NAMES = sorted(row[1] for row in POD_METRICS)

# --- fixed values: interrupts and throttling -------------------------------
CPU_PCT_PER_INTERRUPT = 7.5e-5
LOW_FREQ_SHARE = 0.9

# --- fixed values: run logs ------------------------------------------------
LOG_TAG_PATTERN = r"change the tag to ([^\s\]]+)"
LOG_WINDOW_PATTERN = r'"msg":\s*"(\d+)\s*-\s*(\d+)"'
RUN_NUMBER_PATTERN = r"-(\d+)$"
LOG_PREFIX = "ansible_output_"
START_MARKER = "tmp-before.txt"
END_MARKER = "tmp-after.txt"
DOCUMENT_FIELDS = [
    "hostname", "timestamp", "chart_context", "chart_id", "chart_family",
    "id", "name", "value", "units",
]

# --- fixed values: verdicts ------------------------------------------------
STRENGTH_SCORES = {"strong": 1.0, "moderate": 0.6, "weak": 0.3, "inconclusive": 0.0}
# id, direction, hypothesis
HYPOTHESES = [
    ("P1", "Security → Resource & Cost ↑",
     "Higher CIS security compliance correlates with higher idle CPU/RAM"),
    ("P2", "Resource & Cost → Performance ↓",
     "System overhead grows under load, consuming resources that reduce scheduling capacity"),
    ("P3", "Resource & Cost → Performance ↑",
     "Lightweight distros have lower pod-startup latency"),
    ("P10", "Performance → Resource & Cost ↓",
     "Higher efficiency enables equal workload at lower cost"),
    ("P12", "Security → Maintainability ↓",
     "Higher security compliance correlates with longer setup time"),
    ("P14", "Resource & Cost → Security ↓",
     "Lower resource footprint correlates with weaker security"),
]
# --- end of fixed values ---------------------------------------------------


def published(spark: SparkSession) -> DataFrame:
    """One row per system with its published measurements."""
    return fixed_table(spark, PUBLISHED, PUBLISHED_SCHEMA)


def nodes(spark: SparkSession) -> DataFrame:
    """One row per host with type and capacity (CPU in percentage points)."""
    rows = [(h, t, c, c * 100, m) for h, t, c, m in NODES]
    return fixed_table(
        spark, rows, "hostname string, node_type string, cores int, cpu_capacity int, ram_mib int"
    )


def pod_metrics(spark: SparkSession) -> DataFrame:
    """One row per container metric that the silver layer keeps."""
    return fixed_table(spark, POD_METRICS, POD_METRICS_SCHEMA)


def hypotheses(spark: SparkSession) -> DataFrame:
    """One row per hypothesis."""
    return fixed_table(
        spark, HYPOTHESES, "proposition_id string, direction string, hypothesis string"
    )


def labels(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    """A key/label table for display names."""
    return fixed_table(spark, list(mapping.items()), "key string, label string")

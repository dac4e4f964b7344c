"""Rank statistics, comparisons of systems and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions import labels
from tidegauge.operators import comparisons, frequency, overhead, ranks, statistics, verdicts
from tidegauge.plans.inputs import API_LATENCY, POD_STARTUP
from tidegauge.plans.pod_queries import GROWTH_SQL, LOADED, loaded
from tidegauge.plans.rate_queries import RATES
from tidegauge.plans.registry import query
from tidegauge.plans.scan_queries import idle_series
from tidegauge.session import new_table_path, written
from tidegauge.sinks import tables as sinks
from tidegauge.sources import telemetry as sources

_MEASURED = fixed.PUBLISHED_SCHEMA.replace(" string", "").replace(" double", "").split(", ")
_SYSTEMS = ",\n    ".join(str(row) for row in fixed.PUBLISHED)
PUBLISHED = f"""published AS (
  SELECT kd, {", ".join(f"CAST({name} AS DOUBLE) AS {name}" for name in _MEASURED[1:])}
  FROM (VALUES {_SYSTEMS}) AS v({", ".join(_MEASURED)})
)"""


def system_correlations(points: str) -> str:
    """CTEs that rank ``points(pair, a, b)`` and give rho and p for five systems."""
    return f""", points AS ({points}
), point_ranks AS (
  SELECT pair, rank() OVER (PARTITION BY pair ORDER BY a) + (count(*) OVER (PARTITION BY pair, a) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY pair ORDER BY b) + (count(*) OVER (PARTITION BY pair, b) - 1) / 2.0 AS rb
  FROM points
), rhos AS (
  SELECT pair, corr(ra, rb) AS rho, count(*) AS n FROM point_ranks GROUP BY pair
), angles AS (
  SELECT pair, n, rho, CASE WHEN abs(rho) > 0.999999999 THEN pi() / 2
    ELSE atan(abs(rho) / sqrt(1 - rho * rho)) END AS theta FROM rhos
), correlations AS (
  SELECT pair, n, rho, 1 - 2 / pi() * (theta + sin(theta) * cos(theta)) AS p FROM angles
)"""


# --- start-up and API latency ------------------------------------------------
@query(
    "startup_by_kd_test", ctes=POD_STARTUP, rounds="mean_ms std_ms",
    sql="""SELECT kd, tests, avg(medians) AS mean_ms, stddev_samp(medians) AS std_ms
    FROM pod_startup GROUP BY kd, tests""",
)
def startup_by_kd_test(t):
    return comparisons.startup_by_kd_test(t.pod_startup)


AT_SCALE = """SELECT kd, avg(medians) AS latency_ms FROM pod_startup
    WHERE tests = 'cp_heavy_12client' AND number_of_pods = 120 GROUP BY kd"""


@query("startup_at_scale", ctes=POD_STARTUP, sql=AT_SCALE, rounds="latency_ms")
def startup_at_scale(t):
    return comparisons.startup_at_scale(t.pod_startup)


@query(
    "slowdown_ratio", ctes=POD_STARTUP, rounds="worst_ms best_ms slowdown",
    sql=f"""SELECT w.latency_ms AS worst_ms, b.latency_ms AS best_ms, w.latency_ms / b.latency_ms AS slowdown
    FROM ({AT_SCALE}) w, ({AT_SCALE}) b WHERE w.kd = 'kubeEdge' AND b.kd = 'k3s'""",
)
def slowdown_ratio(t):
    return comparisons.slowdown_ratio(comparisons.startup_at_scale(t.pod_startup))


SVC_MEDIAN = """SELECT kd, median(medians) AS median_ms FROM api_latency
    WHERE tests = 'cp_heavy_12client' AND operations = 'service' AND metrics = 'create' GROUP BY kd"""


@query("svc_create_median", ctes=API_LATENCY, sql=SVC_MEDIAN, rounds="median_ms")
def svc_create_median(t):
    return comparisons.svc_create_median(t.api_latency)


GROUP_MEANS = """SELECT avg(medians) FILTER (kd IN ('k0s', 'k3s')) AS mean_lightweight_ms,
      avg(medians) FILTER (kd IN ('k8s', 'kubeEdge', 'openYurt')) AS mean_heavy_ms,
      avg(maxs) FILTER (kd IN ('k0s', 'k3s')) AS mean_lightweight_max_ms,
      avg(maxs) FILTER (kd IN ('k8s', 'kubeEdge', 'openYurt')) AS mean_heavy_max_ms,
      avg(maxs) FILTER (kd = 'kubeEdge') AS mean_edge_max_ms,
      max(maxs) FILTER (kd = 'kubeEdge') AS max_edge_max_ms,
      avg(medians) FILTER (kd IN ('k8s', 'kubeEdge', 'openYurt'))
        / avg(medians) FILTER (kd IN ('k0s', 'k3s')) AS ratio_heavy_to_lw
    FROM pod_startup"""


@query(
    "group_mean_ratio", ctes=POD_STARTUP, sql=GROUP_MEANS,
    rounds="mean_lightweight_ms mean_heavy_ms mean_lightweight_max_ms mean_heavy_max_ms "
    "mean_edge_max_ms ratio_heavy_to_lw",
)
def group_mean_ratio(t):
    return comparisons.group_mean_ratio(t.pod_startup)


# --- rank statistics ----------------------------------------------------------
@query(
    "rank_average_ties", ctes=API_LATENCY,
    sql="""SELECT DISTINCT operations, medians, count(*) OVER v AS n_tied,
      count(*) OVER (PARTITION BY operations) AS n_total,
      rank() OVER (PARTITION BY operations ORDER BY medians) + (count(*) OVER v - 1) / 2.0 AS mid_rank
    FROM api_latency WINDOW v AS (PARTITION BY operations, medians)""",
)
def rank_average_ties(t):
    return ranks.rank_average_ties(t.api_latency, ["operations"], "medians")


T_TAIL = """(1 - 2 * (SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END
        * pow(1 + pow(tt * i / 2000, 2) / df, -(df + 1) / 2)) * tt / 6000
        * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) FROM range(2001) AS g(i)))"""


@query(
    "spearman", ctes=POD_STARTUP, rounds="spearman_rho p_value",
    sql=f""", ranked AS (
      SELECT kd, rank() OVER (PARTITION BY kd ORDER BY number_of_pods)
          + (count(*) OVER (PARTITION BY kd, number_of_pods) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY kd ORDER BY medians)
          + (count(*) OVER (PARTITION BY kd, medians) - 1) / 2.0 AS ry
      FROM pod_startup
    ), rho AS (SELECT kd, corr(rx, ry) AS rho, count(*) AS n FROM ranked GROUP BY kd
    ), tvals AS (SELECT kd, rho, n, CAST(n - 2 AS DOUBLE) AS df, abs(rho) * sqrt((n - 2) / ((1 - rho) * (1 + rho))) AS tt FROM rho)
    --result
    SELECT kd, rho AS spearman_rho, {T_TAIL} AS p_value, n FROM tvals""",
)
def spearman(t):
    return statistics.spearman(t.pod_startup, ["kd"], "number_of_pods", "medians")


Z_TAIL = """(0.5 - sign({z}) * (SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END
        * exp(-pow(least(abs({z}), 12.0) * i / 2000, 2) / 2)) * least(abs({z}), 12.0) / 6000 / sqrt(2 * pi())
        FROM range(2001) AS g(i)))"""
MW = """, measured AS (
  SELECT tests, 'medians' AS measure, kd, medians AS v FROM pod_startup
  UNION ALL SELECT tests, 'mins', kd, mins FROM pod_startup
  UNION ALL SELECT 'all', 'medians', kd, medians FROM pod_startup
), mw_ranked AS (
  SELECT tests, measure, kd IN ('k0s', 'k3s') AS light,
    rank() OVER (PARTITION BY tests, measure ORDER BY v)
      + (count(*) OVER (PARTITION BY tests, measure, v) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY tests, measure, v) AS ties
  FROM measured
), mw_sums AS (
  SELECT tests, measure, count(*) FILTER (light) AS n1, count(*) FILTER (NOT light) AS n2,
    sum(r) FILTER (light) AS rs, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie
  FROM mw_ranked GROUP BY tests, measure
), mw AS (
  SELECT tests, measure, n1, n2, rs - n1 * (n1 + 1) / 2.0 AS u,
    (n1 * n2 / 2.0 - 0.5 - (rs - n1 * (n1 + 1) / 2.0))
      / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - tie / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS z
  FROM mw_sums
)"""


@query(
    "mann_whitney_less", ctes=POD_STARTUP, rounds="p_value", digits=8,
    sql=MW + f"""
    --result
    SELECT tests, measure, n1, n2, u AS u_statistic, {Z_TAIL.format(z="z")} AS p_value FROM mw
    WHERE tests <> 'all'""",
)
def mann_whitney_less(t):
    measures = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("medians", "mins")]
    )
    rows = t.pod_startup.select("tests", "kd", F.inline(measures))
    return statistics.mann_whitney_less(
        rows, ["tests", "measure"], "v", comparisons.lightweight_flag()
    )


POD_CREATE = API_LATENCY.rstrip() + f""", measured AS (
  SELECT tests, kd IN ('k0s', 'k3s') AS light, medians AS v FROM api_latency
  WHERE tests = 'cp_heavy_12client' AND operations = 'pod' AND metrics = 'create' AND medians IS NOT NULL
    AND kd IN ('k0s', 'k3s', 'k8s', 'kubeEdge', 'openYurt')
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY tests ORDER BY v) + (count(*) OVER (PARTITION BY tests, v) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY tests, v) AS ties
  FROM measured
), sums AS (
  SELECT tests, count(*) FILTER (light) AS n1, count(*) FILTER (NOT light) AS n2,
    sum(r) FILTER (light) AS rs, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie
  FROM ranked GROUP BY tests
), rank_test AS (
  SELECT tests, n1, n2, rs - n1 * (n1 + 1) / 2.0 AS u,
    (n1 * n2 / 2.0 - 0.5 - (rs - n1 * (n1 + 1) / 2.0))
      / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - tie / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS z
  FROM sums
)
"""


@query(
    "mann_whitney_pod_create", ctes=POD_CREATE, rounds="p_value", digits=8,
    sql=f"""SELECT tests, n1, n2, u AS u_statistic, {Z_TAIL.format(z="z")} AS p_value FROM rank_test""",
)
def mann_whitney_pod_create(t):
    pods = comparisons.operation_rows(t.api_latency, "pod", "create")
    return statistics.mann_whitney_less(
        pods, ["tests"], "medians", comparisons.lightweight_flag()
    )


@query(
    "linear_trend", ctes=POD_STARTUP, rounds="slope intercept",
    sql="""SELECT kd, regr_slope(medians, number_of_pods) AS slope,
      regr_intercept(medians, number_of_pods) AS intercept FROM pod_startup GROUP BY kd""",
)
def linear_trend(t):
    return statistics.linear_trend(t.pod_startup, ["kd"], "number_of_pods", "medians")


@query(
    "freq_latency_corr", rounds="spearman_rho p_value",
    ctes=RATES.rstrip() + f", {PUBLISHED}" + system_correlations(
        """SELECT 'cp_freq_vs_pod_latency' AS pair, mean_freq_mhz AS a, startup_120_ms AS b
        FROM freq_stats JOIN published USING (kd) WHERE test_type = 'cp_heavy_12client'
        UNION ALL SELECT 'dp_freq_vs_dp_latency', mean_freq_mhz, dp_latency_ms
        FROM freq_stats JOIN published USING (kd) WHERE test_type = 'dp_redis_density'
        UNION ALL SELECT 'dp_freq_vs_throughput', mean_freq_mhz, dp_ops
        FROM freq_stats JOIN published USING (kd) WHERE test_type = 'dp_redis_density'
        UNION ALL SELECT 'cp_freq_cv_vs_pod_latency', freq_cv, startup_120_ms
        FROM freq_stats JOIN published USING (kd) WHERE test_type = 'cp_heavy_12client'"""
    ) + "\n",
    sql="SELECT pair AS comparison, rho AS spearman_rho, p AS p_value, n FROM correlations",
)
def freq_latency_corr(t):
    return comparisons.freq_latency_corr(frequency.freq_stats(t.telemetry), t.published)


@query(
    "significance_stars", ctes=API_LATENCY,
    sql="""SELECT kd, operations, tests, test_number, metrics, medians,
      CASE WHEN kd = 'k0s' THEN 'ns (constant freq)' WHEN medians < 5 THEN '***' WHEN medians < 50 THEN '**'
        WHEN medians < 250 THEN '*' ELSE 'ns' END AS significance
    FROM api_latency""",
)
def significance_stars(t):
    p = F.when(F.col("kd") != "k0s", F.col("medians") / 5000)
    return t.api_latency.select(
        "kd", "operations", "tests", "test_number", "metrics", "medians",
        labels.stars(p).alias("significance"),
    )


@query(
    "display_names", ctes=RATES,
    sql="""SELECT kd, test_type, CASE kd WHEN 'kubeEdge' THEN 'KubeEdge' WHEN 'openYurt' THEN 'OpenYurt' ELSE kd END AS kd_label,
      CASE test_type WHEN 'idle' THEN 'Idle' WHEN 'cp_heavy_12client' THEN 'CP Heavy' || chr(10) || '(12 clients)'
        ELSE 'DP Redis' || chr(10) || 'Density' END AS test_label, count(*) AS n
    FROM telemetry GROUP BY kd, test_type""",
)
def display_names(t):
    counts = t.telemetry.groupBy("kd", "test_type").agg(F.count("*").alias("n"))
    named = comparisons.with_label(counts, "kd", fixed.KD_LABELS, "kd_label")
    return comparisons.with_label(named, "test_type", fixed.TEST_LABELS, "test_label")


# --- measured idle use beside published values ---------------------------------
MEASURED = RATES.rstrip() + f""", {PUBLISHED}, idle_series AS (
  SELECT kd, kd || '-idle-' || CAST(run AS VARCHAR) AS run, hostname, value FROM telemetry
  WHERE test_type = 'idle' AND chart_context = 'system.cpu' AND metric_id = 'idle'
), measured AS (
  SELECT kd, 100.0 - avg(value) FILTER (hostname <> 'master') AS cpu_usage, count(DISTINCT run) AS n_files,
    count(DISTINCT hostname) FILTER (hostname <> 'master') AS n_workers
  FROM idle_series GROUP BY kd
)
"""


def measured_idle(t):
    return comparisons.measured_idle_cpu(idle_series(t))


@query("measured_idle_cpu", ctes=MEASURED, sql="SELECT * FROM measured", rounds="cpu_usage")
def measured_idle_cpu(t):
    return measured_idle(t)


@query(
    "join_kd_constants", ctes=MEASURED, rounds="cpu_usage",
    sql="SELECT m.*, p.* EXCLUDE (kd) FROM measured m JOIN published p USING (kd)",
)
def join_kd_constants(t):
    return comparisons.join_kd_constants(measured_idle(t), t.published)


@query(
    "cross_validation", ctes=MEASURED, rounds="cpu_usage difference_pct",
    sql="""SELECT m.*, p.idle_cpu_pct AS published_pct, m.cpu_usage - p.idle_cpu_pct AS difference_pct
    FROM measured m JOIN published p USING (kd)""",
)
def cross_validation(t):
    return comparisons.cross_validation(measured_idle(t), t.published)


def systems(t):
    return comparisons.join_kd_constants(measured_idle(t).select("kd", "cpu_usage"), t.published)


@query(
    "throughput_efficiency", ctes=MEASURED, rounds="ops_per_cpu efficiency_spread",
    sql="""SELECT kd, dp_ops / cpu_usage AS ops_per_cpu,
      max(dp_ops / cpu_usage) OVER () / greatest(min(dp_ops / cpu_usage) OVER (), 1.0) AS efficiency_spread
    FROM measured JOIN published USING (kd)""",
)
def throughput_efficiency(t):
    rows = comparisons.throughput_efficiency(systems(t), cpu="cpu_usage")
    return rows.select("kd", "ops_per_cpu", "efficiency_spread")


@query(
    "latency_efficiency", ctes=MEASURED, rounds="latency_efficiency", digits=9,
    sql="""SELECT kd, 1.0 / (dp_latency_ms * cpu_usage) AS latency_efficiency
    FROM measured JOIN published USING (kd)""",
)
def latency_efficiency(t):
    rows = comparisons.latency_efficiency(systems(t), cpu="cpu_usage")
    return rows.select("kd", "latency_efficiency")


@query(
    "efficiency_ranking", ctes=MEASURED, rounds="ops_per_cpu",
    sql="""SELECT kd, dp_ops / cpu_usage AS ops_per_cpu,
      CAST(row_number() OVER (ORDER BY dp_ops / cpu_usage DESC, kd) AS INT) AS position
    FROM measured JOIN published USING (kd)""",
)
def efficiency_ranking(t):
    rows = comparisons.throughput_efficiency(systems(t), cpu="cpu_usage")
    return comparisons.efficiency_ranking(rows, "ops_per_cpu").select(
        "kd", "ops_per_cpu", "position"
    )


# --- verdicts -------------------------------------------------------------------
def footprint(t):
    """Measured idle use per system; several verdicts read it, so it is written once."""
    return t.once("footprint", lambda: comparisons.idle_footprint(t.telemetry))


def points(t):
    """One row per system with everything the verdicts correlate, written once."""

    def build():
        effort = t.pod_startup.groupBy("kd").agg(
            (F.avg("medians") / 3_600_000).alias("setup_hours")
        )
        published = t.published.select("kd", "security_pct", "dp_ops")
        return (
            comparisons.join_kd_constants(footprint(t), published)
            .join(comparisons.svc_create_median(t.api_latency), "kd", "left")
            .join(effort, "kd", "left")
        )

    return t.once("points", build)


def correlations(t):
    """All correlations over systems in one row, written once."""
    return t.once("correlations", lambda: verdicts.system_correlations(points(t)))


def p1(t):
    return verdicts.verdict_p1(correlations(t))


def p2(t):
    growth = t.once("growth", lambda: overhead.growth_factor(loaded(t)))
    return verdicts.verdict_p2(correlations(t), growth)


def p3(t):
    rows = t.pod_startup.withColumn("scope", F.lit("all"))
    test = statistics.mann_whitney_less(rows, ["scope"], "medians", comparisons.lightweight_flag())
    return verdicts.verdict_p3(test, comparisons.group_mean_ratio(t.pod_startup))


def p10(t):
    return verdicts.verdict_p10(correlations(t), comparisons.throughput_efficiency(points(t)))


def p12(t):
    return verdicts.verdict_p12(correlations(t))


def p14(t):
    return verdicts.verdict_p14(correlations(t))


VERDICT_ROWS = {"p1": p1, "p2": p2, "p3": p3, "p10": p10, "p12": p12, "p14": p14}


def _tail(ctes: str) -> str:
    """CTEs after the leading WITH, to follow other CTEs."""
    return ", " + ctes.strip().removeprefix("WITH ")


VERDICTS = (
    LOADED.rstrip()
    + _tail(POD_STARTUP)
    + _tail(API_LATENCY)
    + f""", {PUBLISHED}, idle_cpu AS (
  SELECT kd, 100.0 - avg(value) FILTER (hostname <> 'master') AS cpu FROM telemetry
  WHERE test_type = 'idle' AND chart_context = 'system.cpu' AND metric_id = 'idle' GROUP BY kd
), idle_ram AS (
  SELECT kd, avg(value) AS ram FROM telemetry
  WHERE test_type = 'idle' AND chart_context = 'k8s.cgroup.mem_usage' AND metric_id = 'ram' GROUP BY kd
), svc AS ({SVC_MEDIAN}
), effort AS (SELECT kd, avg(medians) / 3600000 AS hours FROM pod_startup GROUP BY kd
), growth AS ({GROWTH_SQL}
), means AS ({GROUP_MEANS}
)"""
    + MW
    + system_correlations(
        """SELECT 'cpu' AS pair, security_pct AS a, cpu AS b FROM published JOIN idle_cpu USING (kd)
        UNION ALL SELECT 'ram', security_pct, ram FROM published JOIN idle_ram USING (kd)
        UNION ALL SELECT 'svc', cpu, median_ms FROM idle_cpu JOIN svc USING (kd)
        UNION ALL SELECT 'eff', dp_ops, 1 / cpu FROM published JOIN idle_cpu USING (kd)
        UNION ALL SELECT 'setup', security_pct, hours FROM published JOIN effort USING (kd)"""
    )
    + f""", one AS (
  SELECT max(rho) FILTER (pair = 'cpu') AS cpu, max(p) FILTER (pair = 'cpu') AS cpu_p,
    max(rho) FILTER (pair = 'ram') AS ram, max(p) FILTER (pair = 'ram') AS ram_p,
    max(rho) FILTER (pair = 'svc') AS svc, max(rho) FILTER (pair = 'eff') AS eff, max(p) FILTER (pair = 'eff') AS eff_p,
    max(rho) FILTER (pair = 'setup') AS setup, max(p) FILTER (pair = 'setup') AS setup_p FROM correlations
), grown AS (SELECT max(growth_factor) AS g FROM growth WHERE kd = 'k0s' AND test_type = 'cp_heavy_12client'
), mw_all AS (SELECT u, {Z_TAIL.format(z="z")} AS p FROM mw WHERE tests = 'all'
), spread AS (
  SELECT max(dp_ops / cpu) / greatest(min(dp_ops / cpu), 1.0) AS s, max(dp_ops / cpu) FILTER (kd = 'k3s') AS k3s,
    max(dp_ops / cpu) FILTER (kd = 'kubeEdge') AS ke FROM published JOIN idle_cpu USING (kd)
), outcomes AS (  -- fixed values: the thresholds of the verdict rules
  SELECT 'P1' AS proposition_id, cpu > 0.3 AND ram > 0.3 AS supported,
    CASE WHEN cpu > 0.7 AND ram > 0.7 THEN 'strong' WHEN cpu > 0.4 OR ram > 0.4 THEN 'moderate'
      WHEN cpu > 0.2 OR ram > 0.2 THEN 'weak' ELSE 'inconclusive' END AS strength, cpu AS main_statistic,
    printf('spearman_rho_cpu = %.4f; spearman_rho_ram = %.4f; spearman_p_cpu = %.4f; spearman_p_ram = %.4f', cpu, ram, cpu_p, ram_p) AS evidence,
    4 AS n_statistics FROM one
  UNION ALL SELECT 'P2', g > 3 OR svc > 0.3,
    CASE WHEN g > 5 THEN 'strong' WHEN g > 2 THEN 'moderate' ELSE 'weak' END, g,
    printf('spearman_rho_svc_create = %.4f; k0s_system_cpu_growth_factor = %.4f', svc, g), 2 FROM one, grown
  UNION ALL SELECT 'P3', p < 0.05 AND mean_lightweight_ms < mean_heavy_ms,
    CASE WHEN p < 0.01 AND ratio_heavy_to_lw > 1.5 THEN 'strong' WHEN p < 0.05 THEN 'moderate'
      WHEN mean_lightweight_ms < mean_heavy_ms THEN 'weak' ELSE 'inconclusive' END, u,
    printf('mann_whitney_U = %.4f; mann_whitney_p = %.4f; mean_lightweight_ms = %.4f; mean_heavy_ms = %.4f; ratio_heavy_to_lw = %.4f',
      u, p, mean_lightweight_ms, mean_heavy_ms, ratio_heavy_to_lw), 5 FROM mw_all, means
  UNION ALL SELECT 'P10', k3s > ke AND s > 3,
    CASE WHEN s > 10 THEN 'strong' WHEN s > 5 THEN 'moderate' WHEN s > 2 THEN 'weak' ELSE 'inconclusive' END, s,
    printf('spearman_rho = %.4f; spearman_p = %.4f; efficiency_spread = %.4f', eff, eff_p, s), 3 FROM spread, one
  UNION ALL SELECT 'P12', setup > 0.3,
    CASE WHEN setup > 0.7 THEN 'strong' WHEN setup > 0.4 THEN 'moderate' ELSE 'weak' END, setup,
    printf('spearman_rho = %.4f; spearman_p = %.4f', setup, setup_p), 2 FROM one
  UNION ALL SELECT 'P14', cpu > 0.3 OR ram > 0.3,
    CASE WHEN cpu > 0.7 OR ram > 0.7 THEN 'strong' WHEN cpu > 0.4 OR ram > 0.4 THEN 'moderate'
      WHEN cpu > 0.2 OR ram > 0.2 THEN 'weak' ELSE 'inconclusive' END, cpu,
    printf('spearman_rho_cpu = %.4f; spearman_rho_ram = %.4f; spearman_p_cpu = %.4f; spearman_p_ram = %.4f', cpu, ram, cpu_p, ram_p), 4 FROM one
), verdicts AS (
  SELECT *, CASE WHEN supported THEN 'SUPPORTED (' ELSE 'NOT SUPPORTED (' END || strength || ')' AS verdict FROM outcomes
)
"""
)
MAIN_STATISTIC = {
    "p1": "spearman_rho_cpu",
    "p2": "k0s_system_cpu_growth_factor",
    "p3": "mann_whitney_U",
    "p10": "efficiency_spread",
    "p12": "spearman_rho",
    "p14": "spearman_rho_cpu",
}


def _register(name: str) -> None:
    @query(
        f"verdict_{name}",
        ctes=VERDICTS,
        sql=f"""SELECT proposition_id, supported, strength, verdict, main_statistic FROM verdicts
        WHERE proposition_id = '{name.upper()}'""",
        rounds="main_statistic",
    )
    def one(t):
        return VERDICT_ROWS[name](t).select(
            "proposition_id", "supported", "strength", "verdict",
            F.col("statistics")[MAIN_STATISTIC[name]].alias("main_statistic"),
        )


for _name in VERDICT_ROWS:
    _register(_name)


def all_verdicts(t):
    """The six verdict rows from one row of statistics; all samples are ranked in one pass."""
    samples = verdicts.verdict_samples(t.pod_startup, t.api_latency)
    ranked = written(
        statistics.rank_pass(samples, ["comparison", "kd"], "value", F.col("is_first")), "rank-pass"
    )
    row = verdicts.verdict_statistics(
        ranked, t.pod_startup, comparisons.idle_footprint(t.telemetry), overhead.mean_system_cpu(t.silver), t.published
    )
    return verdicts.all_verdicts(row)


@query(
    "verdict_record", ctes=VERDICTS,
    sql="""SELECT proposition_id, supported, strength, verdict, evidence, n_statistics FROM verdicts""",
)
def verdict_record(t):
    return all_verdicts(t).select(
        "proposition_id", "supported", "strength", "verdict",
        F.array_join("evidence", "; ").alias("evidence"),
        F.size("statistics").alias("n_statistics"),
    )


@query(
    "verdict_summary", ctes=VERDICTS, rounds="mean_strength",
    sql="""SELECT count(*) FILTER (supported) AS n_supported, count(*) AS n_total,
      avg(CASE strength WHEN 'strong' THEN 1.0 WHEN 'moderate' THEN 0.6 WHEN 'weak' THEN 0.3 ELSE 0.0 END) AS mean_strength
    FROM verdicts""",
)
def verdict_summary(t):
    return verdicts.verdict_summary(all_verdicts(t))


@query(
    "sink_verdicts", ctes=VERDICTS,
    sql="SELECT proposition_id, supported, strength, verdict FROM verdicts",
)
def sink_verdicts(t):
    flat, nested = new_table_path(t.spark, "verdicts"), new_table_path(t.spark, "verdict-details")
    sinks.write_verdicts(written(all_verdicts(t), "verdict-rows"), flat, nested)
    schema = (
        "proposition_id string, direction string, hypothesis string, supported boolean, "
        "strength string, verdict string"
    )
    return sources.read_result_csv(t.spark, flat, schema).drop("direction", "hypothesis")


@query(
    "verdict_text", ctes=POD_STARTUP,
    sql="""SELECT kd, tests, test_number, number_of_pods, medians,
      CASE WHEN tests = 'cp_heavy_12client' THEN 'INCONCLUSIVE'
        WHEN tests = 'cp_light_1client' THEN 'SUPPORTED (' || CASE WHEN medians > 9000 THEN 'strong' ELSE 'weak' END || ')'
        ELSE 'NOT SUPPORTED (' || CASE WHEN medians > 9000 THEN 'strong' ELSE 'weak' END || ')' END AS verdict
    FROM pod_startup""",
)
def verdict_text(t):
    supported = F.when(F.col("tests") == "cp_light_1client", True).when(
        F.col("tests") == "cp_heavy_8client", False
    )
    strength = labels.graded((F.col("medians") > 9000, "strong"), otherwise="weak")
    return t.pod_startup.select(
        "kd", "tests", "test_number", "number_of_pods", "medians",
        labels.verdict_text(supported, strength).alias("verdict"),
    )

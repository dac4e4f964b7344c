"""Published statistics recomputed from inlined inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions import probability as tails
from tidegauge.operators import (
    comparisons,
    energy,
    interrupts,
    overhead,
    statistics,
    verdicts,
)

# median start-up latency: value, rows
LIGHT = [(1000.0, 22), (2000.0, 17), (3000.0, 1), (4000.0, 9), (5000.0, 2), (6000.0, 9)]
HEAVY = [
    (1000.0, 12), (2000.0, 37), (3000.0, 6), (4000.0, 9), (5000.0, 5), (6000.0, 6),
    (7000.0, 3), (8000.0, 1), (8999.999, 3), (10000.0, 3), (12000.0, 1), (15000.001, 1),
    (19000.0, 1), (62000.0, 1), (63000.0, 1),
]
IDLE_IRQ = {
    "k0s": [1186.268, 1166.766, 1177.935, 1181.744, 1167.42],
    "k3s": [977.204, 982.095, 997.343, 1021.859, 988.648],
    "k8s": [939.002, 942.043, 937.025, 937.734, 929.704],
    "kubeEdge": [1238.675, 1250.034, 1246.613, 1233.394, 1230.69],
    "openYurt": [1303.381, 1304.988, 1313.581, 1316.249, 1310.425],
}
# kd, test, mean frequency, variation
FREQUENCIES = [
    ("k0s", "cp_heavy_12client", 900.8746073011077, 0.23514303442430987),
    ("k3s", "cp_heavy_12client", 839.4746898484849, 0.24969897824587836),
    ("k3s", "dp_redis_density", 1325.4603031932427, 0.2390265009733595),
    ("k8s", "cp_heavy_12client", 787.7641535535537, 0.21571577107297948),
    ("k8s", "dp_redis_density", 1287.1045269056447, 0.2653218712075351),
    ("kubeEdge", "cp_heavy_12client", 834.7754569937957, 0.1577039164231886),
    ("kubeEdge", "dp_redis_density", 1266.3925913116123, 0.2672712920642456),
    ("openYurt", "cp_heavy_12client", 849.9650623004695, 0.2172762590287895),
    ("openYurt", "dp_redis_density", 1315.9265432955024, 0.24610400546200858),
]
# medians of the five heavy runs with 120 pods
AT_120 = {
    "k0s": [6000.0, 6000.0, 6000.0, 6000.0, 6000.0],
    "k3s": [5000.0, 6000.0, 6000.0, 6000.0, 6000.0],
    "k8s": [5000.0, 6000.0, 5000.0, 6000.0, 6000.0],
    "kubeEdge": [62000.0, 15000.001, 63000.0, 19000.0, 10000.0],
    "openYurt": [8000.0, 7000.0, 7000.0, 8999.999, 7000.0],
}
# medians of service creation and of pod creation under the heavy test
SERVICE_CREATE = {
    "k0s": [108.181, 87.388, 89.994, 100.941, 101.663],
    "k3s": [25.116, 27.395, 26.339, 28.052, 34.908],
    "k8s": [78.662, 88.632, 89.153, 98.548, 93.711],
    "kubeEdge": [91.439, 96.742, 92.857, 99.433, 92.617],
    "openYurt": [98.07, 97.635, 96.6, 92.628, 96.78],
}
POD_CREATE = {
    "k0s": [31.068, 18.598, 20.823, 17.337, 23.849],
    "k3s": [23.464, 17.38, 20.466, 18.385, 22.191],
    "k8s": [18.477, 26.027, 25.323, 22.812, 23.965],
    "kubeEdge": [13.017, 17.846, 19.428, 19.267, 17.766],
    "openYurt": [24.011, 18.978, 13.098, 17.049, 23.716],
}


@pytest.fixture(scope="module")
def startup(spark):
    rows = [("k0s", v, n) for v, n in LIGHT] + [("k8s", v, n) for v, n in HEAVY]
    counted = spark.createDataFrame(rows, "kd string, medians double, n int")
    return counted.select(
        F.lit("all").alias("scope"), "kd", "medians", F.col("medians").alias("maxs"),
        F.explode(F.sequence(F.lit(1), "n")),
    ).drop("col")


def near(value, expected, relative=1e-9):
    return math.isclose(value, expected, rel_tol=relative, abs_tol=1e-14)


def test_mann_whitney(startup):
    row = statistics.mann_whitney_less(
        startup, ["scope"], "medians", comparisons.lightweight_flag()
    ).first()
    assert (row.n1, row.n2, row.u_statistic) == (60, 90, 2019.0)
    assert near(row.p_value, 0.0035265153862118087)


def test_verdict_p3(startup):
    test = statistics.mann_whitney_less(
        startup, ["scope"], "medians", comparisons.lightweight_flag()
    )
    row = verdicts.verdict_p3(test, comparisons.group_mean_ratio(startup)).first()
    assert (row.supported, row.verdict) == (True, "SUPPORTED (strong)")
    assert near(row.statistics["ratio_heavy_to_lw"], 1.9203354213836479, 1e-7)


def heavy_rows(values):
    return [(kd, "cp_heavy_12client", 120, v) for kd, found in values.items() for v in found]


def test_startup_at_scale_and_slowdown(spark):
    rows = spark.createDataFrame(
        heavy_rows(AT_120), "kd string, tests string, number_of_pods int, medians double"
    )
    at_scale = comparisons.startup_at_scale(rows)
    found = {r.kd: round(r.latency_ms, 3) for r in at_scale.collect()}
    assert found == {
        "k0s": 6000.0, "k3s": 5800.0, "k8s": 5600.0, "kubeEdge": 33800.0, "openYurt": 7600.0,
    }
    assert near(comparisons.slowdown_ratio(at_scale).first().slowdown, 33800.0002 / 5800)


def test_api_latency_statistics(spark):
    rows = [
        (kd, operation, "cp_heavy_12client", "create", v)
        for operation, values in (("service", SERVICE_CREATE), ("pod", POD_CREATE))
        for kd, found in values.items()
        for v in found
    ]
    api = spark.createDataFrame(
        rows, "kd string, operations string, tests string, metrics string, medians double"
    )
    medians = {r.kd: round(r.median_ms, 1) for r in comparisons.svc_create_median(api).collect()}
    assert medians == {
        "k0s": 100.9, "k3s": 27.4, "k8s": 89.2, "kubeEdge": 92.9, "openYurt": 96.8,
    }
    pods = comparisons.operation_rows(api, "pod", "create")
    row = statistics.mann_whitney_less(
        pods, ["tests"], "medians", comparisons.lightweight_flag()
    ).first()
    assert (row.n1, row.n2, row.u_statistic, round(row.p_value, 4)) == (10, 15, 80.0, 0.6198)


def test_tax_share_growth(spark):
    loaded = spark.createDataFrame(
        [
            ("k0s", "idle", "system", "cpu_pct", 1.521948),
            ("k0s", "cp_heavy_12client", "system", "cpu_pct", 14.017228),
            ("k0s", "cp_heavy_12client", "system", "mem_mib", 60.424822),
            ("k0s", "dp_redis_density", "system", "cpu_pct", 1.157927),
            ("k0s", "dp_redis_density", "workload", "cpu_pct", 206.106908),
        ],
        "kd string, test_type string, role string, metric string, mean double",
    )
    tax = {
        (r.test_type, r.metric): (round(r.orchestration_tax_pct, 6), r.node_capacity)
        for r in overhead.orchestration_tax(loaded, fixed.nodes(spark)).collect()
    }
    assert tax["cp_heavy_12client", "cpu_pct"] == (3.504307, 400)
    assert tax["cp_heavy_12client", "mem_mib"] == (0.737608, 8192)
    assert tax["dp_redis_density", "cpu_pct"] == (0.289482, 400)
    assert ("dp_redis_density", "mem_mib") not in tax
    growth = {r.test_type: r.growth_factor for r in overhead.growth_factor(loaded).collect()}
    assert near(growth["cp_heavy_12client"], 9.210057, 1e-6) and growth["idle"] == 1.0
    share = overhead.workload_share(loaded).first()
    assert round(share.workload_share_pct, 1) == 99.4


def test_interrupt_cost(spark):
    key = "kd string, test_type string, run int"
    irq = spark.createDataFrame([("k0s", "idle", 1, 1186.2675808994536)], f"{key}, irq_rate double")
    soft = spark.createDataFrame([("k0s", "idle", 1, 417.05284254972673)], f"{key}, softirq_rate double")
    both = irq.join(soft, ["kd", "test_type", "run"], "full")
    row = interrupts.irq_cpu_overhead(both).first()
    assert near(row.irq_cpu_overhead_pct, 0.08897006856745902, 1e-14)
    assert near(row.total_cpu_overhead_pct, 0.12024903175868853, 1e-14)


def test_energy_per_pod_and_operation(spark):
    rows = [
        ("k3s", "cp_heavy_12client", 839.55, 201.7, 3.714985, 0.46, 1233.4195592984706, 332),
        ("k3s", "dp_redis_density", 1329.37, 308.1, 4.864075, 0.72, 4177.824752036047, 862),
    ]
    estimates = spark.createDataFrame(
        rows,
        "kd string, test_type string, mean_freq_mhz double, std_freq_mhz double, "
        "mean_power_w double, std_power_w double, energy_j double, duration_s bigint",
    )
    row = energy.energy_efficiency(estimates, fixed.published(spark)).first()
    assert near(row.energy_per_pod_j, 10.278496327487256)
    assert near(row.energy_per_op_mj, 0.2817828165998521)
    assert row.cp_overhead_w is None and row.idle_power_w_mean is None


def test_security_verdicts(spark):
    systems = fixed.published(spark)
    one = verdicts.verdict_p1(verdicts.system_correlations(systems)).first()
    assert one.verdict == "SUPPORTED (strong)"
    assert near(one.statistics["spearman_rho_cpu"], 0.894427190999916)
    assert near(one.statistics["spearman_p_cpu"], 0.040519326353834)
    twelve = verdicts.verdict_p12(verdicts.system_correlations(systems)).first()
    assert near(twelve.statistics["spearman_rho"], 0.917662935482247)
    assert near(twelve.statistics["spearman_p"], 0.028008456010146)
    assert verdicts.verdict_p14(verdicts.system_correlations(systems)).first().verdict == "SUPPORTED (strong)"


def test_efficiency_verdict(spark):
    published = fixed.published(spark)
    row = verdicts.verdict_p10(
        verdicts.system_correlations(published), comparisons.throughput_efficiency(published)
    ).first()
    assert row.verdict == "SUPPORTED (strong)"
    assert near(row.statistics["spearman_rho"], 0.2)
    assert near(row.statistics["spearman_p"], 0.7470600781046621)


def test_growth_verdict(spark):
    points = spark.createDataFrame(
        [("k0s", 4.0, 100.9), ("k3s", 1.5, 27.4), ("k8s", 5.2, 89.2), ("kubeEdge", 6.8, 92.9),
         ("openYurt", 5.6, 96.8)],
        "kd string, idle_cpu_pct double, median_ms double",
    )
    growth = spark.createDataFrame(
        [("k0s", "cp_heavy_12client", 9.210057111018246)],
        "kd string, test_type string, growth_factor double",
    )
    row = verdicts.verdict_p2(verdicts.system_correlations(points), growth).first()
    assert row.verdict == "SUPPORTED (strong)"
    assert near(row.statistics["spearman_rho_svc_create"], 0.3)


def test_kruskal_wallis(spark):
    rows = [("idle", kd, value) for kd, values in IDLE_IRQ.items() for value in values]
    rates = spark.createDataFrame(rows, "test_type string, kd string, irq_rate double")
    row = statistics.kruskal_wallis(rates, ["test_type"], "kd", "irq_rate").first()
    assert near(row.kruskal_h, 23.07692307692308)
    assert near(row.kruskal_p, 1.2222331995353944e-4)
    assert (row.n_groups, row.significance) == (5, "***")


def test_frequency_correlations(spark):
    frequencies = spark.createDataFrame(
        FREQUENCIES, "kd string, test_type string, mean_freq_mhz double, freq_cv double"
    )
    rows = {
        row.comparison: row
        for row in comparisons.freq_latency_corr(frequencies, fixed.published(spark)).collect()
    }
    expected = {
        "cp_freq_vs_pod_latency": (0.1, 0.8728885715695384, 5),
        "dp_freq_vs_dp_latency": (-0.2, 0.8, 4),
        "dp_freq_vs_throughput": (0.2, 0.8, 4),
        "cp_freq_cv_vs_pod_latency": (-0.7, 0.1881204043741873, 5),
    }
    assert set(rows) == set(expected)
    for name, (rho, p, n) in expected.items():
        assert near(rows[name].spearman_rho, rho) and near(rows[name].p_value, p)
        assert rows[name].n == n


def t_tail(t, df):
    """Two-sided tail by numerical integration."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    steps = 20000
    width = t / steps
    total = 0.0
    for i in range(steps + 1):
        weight = 1 if i in (0, steps) else 4 if i % 2 else 2
        total += weight * (1 + (i * width) ** 2 / df) ** (-(df + 1) / 2)
    return 1 - 2 * scale * total * width / 3


@pytest.mark.parametrize("df", [1, 2, 3, 4, 9, 30, 999, 1000, 1001, 1500])
def test_student_tail(spark, df):
    points = [0.0, 0.3, 1.0, 2.5, 6.0]
    rows = spark.createDataFrame([(t, df) for t in points], "t double, df bigint")
    found = rows.select(tails.student_two_sided(F.col("t"), F.col("df"))).collect()
    for t, (value,) in zip(points, found, strict=True):
        assert abs(value - t_tail(t, df)) < 5e-11


def test_normal_tail(spark):
    points = [-9.0, -3.0, -2.5, -1.0, 0.0, 0.5, 2.49, 2.5, 4.0, 8.0, 20.0]
    rows = spark.createDataFrame([(z,) for z in points], "z double")
    found = rows.select(tails.normal_upper(F.col("z"))).collect()
    for z, (value,) in zip(points, found, strict=True):
        assert near(value, 0.5 * math.erfc(z / math.sqrt(2)), 1e-12)


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 10])
def test_chi_square_tail(spark, df):
    # the upper tail at x satisfies Q(x, df + 2) = Q(x, df) + density step
    x = 3.7
    rows = spark.createDataFrame([(x, df)], "x double, df bigint")
    now, later = rows.select(
        tails.chi_square_upper(F.col("x"), F.col("df")),
        tails.chi_square_upper(F.col("x"), F.col("df") + 2),
    ).first()
    step = math.exp(-x / 2 + df / 2 * math.log(x / 2) - math.lgamma(df / 2 + 1))
    assert near(later, now + step, 1e-12)
    if df == 1:
        assert near(now, math.erfc(math.sqrt(x / 2)), 1e-12)
    if df == 2:
        assert near(now, math.exp(-x / 2), 1e-12)

"""Edge semantics on small hand-made tables."""

import itertools
import json
import math
import os
import random
import statistics as plain

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge import schemas, session
from tidegauge.functions import labels, power, probability, tags
from tidegauge.operators import (
    energy,
    frequency,
    ingest,
    interrupts,
    overhead,
    ranks,
    scans,
    silver,
    silver_states,
    statistics,
)
from tidegauge.plans.inputs import Inputs
from tidegauge.sinks import tables as sinks
from tidegauge.sources import benchmarks, documents
from tidegauge.sources import telemetry as sources

SMALL = "/root/testdata/sf0.001"
COLUMNS = schemas.TELEMETRY_PARTITIONED


def reading(context, metric, value, host="node_1", at=0, kd="k0s", test="idle", run=1, chart=None):
    return (
        at, host, context, chart or context, context.split(".")[0], metric, metric, value, "u",
        kd, test, run,
    )


def telemetry(spark, *rows):
    return sources.normalised(spark.createDataFrame(list(rows), COLUMNS))


# --- expressions ---------------------------------------------------------------
def test_activity_and_voltage(spark):
    rows = spark.createDataFrame([(96.0, 600.0), (None, 1800.0), (900.0, 5000.0)], "i double, f double")
    found = rows.select(
        power.activity(F.col("i")), power.voltage(F.col("f")),
        power.power(F.col("f"), power.activity(F.col("i"))),
    ).collect()
    assert [round(r[0], 12) for r in found] == [0.76, 0.5, 0.0]
    assert [round(r[1], 12) for r in found] == [0.8, 1.0, 1.0]
    # full frequency, all busy, is the full-load power
    full = rows.limit(1).select(power.power(F.lit(1800.0), F.lit(1.0))).first()[0]
    assert math.isclose(full, 6.4)


def test_stars_and_verdict_text(spark):
    rows = spark.createDataFrame([(0.0005,), (0.005,), (0.04,), (0.05,), (None,)], "p double")
    assert [r[0] for r in rows.select(labels.stars(F.col("p"))).collect()] == [
        "***", "**", "*", "ns", "ns (constant freq)",
    ]
    states = spark.createDataFrame([(True,), (False,), (None,)], "s boolean")
    assert [r[0] for r in states.select(labels.verdict_text(F.col("s"), F.lit("weak"))).collect()] == [
        "SUPPORTED (weak)", "NOT SUPPORTED (weak)", "INCONCLUSIVE",
    ]


@pytest.mark.parametrize(
    ("tag", "expected"),
    [
        ("idle-1", ["idle-1", "idle-1.", "k0s-idle-1", "k0s-idle-1."]),
        ("k0s-idle-1", ["k0s-idle-1", "k0s-idle-1.", "idle-1"]),
        ("k0s-idle-1.", ["k0s-idle-1.", "idle-1."]),
        ("k0s-a,k0s-b", ["k0s-a,k0s-b", "k0s-a,k0s-b.", "a,k0s-b", "k0s-a.k0s-b.", "k0s-a.k0s-b"]),
    ],
)
def test_tag_candidates(spark, tag, expected):
    row = spark.range(1).select(tags.tag_candidates(F.lit(tag), F.lit("k0s"))).first()
    assert row[0] == expected


def test_log_parsers(spark):
    texts = [
        'x [change the tag to k0s-idle-3,**] y "msg": "10 - 25" z',
        'change the tag to idle-1**,\n"msg":"7-9"',
        "nothing",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(
        tags.log_tag(F.col("t")), tags.log_window(F.col("t"), 1), tags.log_window(F.col("t"), 2)
    ).collect()
    # stars go first, then commas, so a star before a comma stays
    assert [tuple(r) for r in found] == [
        ("k0s-idle-3", 10, 25), ("idle-1**", 7, 9), (None, None, None),
    ]
    marks = spark.createDataFrame([(" 12\n",), ("12.5",), ("x",), ("",)], "t string")
    assert [r[0] for r in marks.select(tags.marker_second(F.col("t"))).collect()] == [12, None, None, None]
    names = spark.createDataFrame([("idle-12",), ("idle",), ("a-1-b",)], "t string")
    assert [r[0] for r in names.select(tags.run_number(F.col("t"))).collect()] == [12, None, None]


# --- energy ----------------------------------------------------------------------
def test_energy_of_one_second_counts_rows(spark):
    row = energy.energy_estimate(
        telemetry(spark, reading(fixed.CTX_FREQ, "cpu0", 600.0))
    ).first()
    assert (row.duration_s, row.energy_j, row.std_power_w) == (1, 0.0, None)
    # half activity where the idle reading is missing
    assert math.isclose(row.mean_power_w, 2.7 + 3.7 * 0.8**2 / 3 * 0.5)


def test_nan_is_skipped_and_master_left_out(spark):
    cells = energy.host_seconds(
        telemetry(
            spark,
            reading(fixed.CTX_FREQ, "cpu0", 700.0),
            reading(fixed.CTX_FREQ, "cpu1", float("nan")),
            reading(fixed.CTX_FREQ, "cpu7", 9999.0),
            reading(fixed.CTX_FREQ, "cpu0", 9999.0, host="master"),
        )
    ).collect()
    assert [(c.hostname, c.mean_freq_mhz, c.mean_idle) for c in cells] == [("node_1", 700.0, None)]


def test_series_summary_is_the_same_for_any_segment(spark):
    rng = random.Random(3)
    times = sorted(rng.sample(range(20000), 400))
    points = [("a", t, rng.uniform(1, 9)) for t in times]
    series = spark.createDataFrame(points, "k string, t bigint, v double")
    area = sum(
        (b[1] - a[1]) * (a[2] + b[2]) / 2 for a, b in zip(points, points[1:], strict=False)
    )
    values = [p[2] for p in points]
    for segment in (10, 700, 10**6):
        row = energy.series_summary(series, ["k"], "t", "v", ["v"], segment).first()
        assert math.isclose(row.integral, area)
        assert (row.span, row.points) == (times[-1] - times[0], 400)
        assert math.isclose(row.mean_v, plain.fmean(values))
        assert math.isclose(row.std_v, plain.stdev(values))


# --- rates -----------------------------------------------------------------------
def test_irq_single_run_has_zero_deviation(spark):
    rows = telemetry(
        spark,
        reading(fixed.CTX_IRQ, "a", 10.0),
        reading(fixed.CTX_IRQ, "b", 20.0),
        reading(fixed.CTX_IRQ, "a", 50.0, host="node_2"),
        reading(fixed.CTX_IRQ, "a", 1000.0, host="master"),
    )
    row = interrupts.irq_rate(interrupts.irq_run_rate(rows)).first()
    assert (row.total_irq_rate_mean, row.total_irq_rate_std) == (40.0, 0.0)


def test_softirq_category_mean_only_over_its_runs(spark):
    rows = telemetry(
        spark,
        reading(fixed.CTX_SOFTIRQ, "RCU", 10.0, run=1),
        reading(fixed.CTX_SOFTIRQ, "RCU", 30.0, run=2),
        reading(fixed.CTX_SOFTIRQ, "HI", 60.0, run=2),
    )
    found = {
        r.category: r for r in interrupts.softirq_breakdown(interrupts.softirq_runs(rows)).collect()
    }
    assert found["HI"].rate_mean == 60.0 and found["RCU"].rate_mean == 20.0
    assert found["HI"].proportion == 0.75
    assert found["RCU"].total_softirq_rate_mean == 50.0


def test_zero_rates(spark):
    rows = telemetry(
        spark,
        reading(fixed.CTX_SOFTIRQ, "RCU", 0.0),
        reading(fixed.CTX_THROTTLE, "cpu0", 0.0, host="master"),
        reading(fixed.CTX_IRQ, "a", 0.0),
        reading(fixed.CTX_IRQ, "a", 5.0, test="dp_redis_density"),
    )
    shares = interrupts.softirq_breakdown(interrupts.softirq_runs(rows)).collect()
    assert [s.proportion for s in shares] == [0.0]
    assert frequency.all_zero_throttle(frequency.throttle_rate(rows)).first().all_zero
    rates = interrupts.irq_rate(interrupts.irq_run_rate(rows))
    assert interrupts.irq_amplification(rates).count() == 0


# --- silver and overhead -----------------------------------------------------------
def chart(pod, container="aa", qos="burstable"):
    return f"cgroup_k8s_kubepods_{qos}_pod{pod}_{container}.cpu"


def test_silver_rules(spark):
    cpu, memory = "k8s.cgroup.cpu", "k8s.cgroup.mem_usage"
    rows = telemetry(
        spark,
        reading(cpu, "user", 1.0, chart=chart("0a-1")),
        reading(cpu, "system", 2.0, chart=chart("0a-1", "bb")),
        reading(cpu, "steal", 99.0, chart=chart("0a-1")),
        reading(cpu, "user", 5.0, chart=chart("0a-1"), at=5),
        reading(memory, "ram", 7.0, chart=chart("0a-1")),
        reading(memory, "ram", 4.0, chart=chart("0a-1", "bb")),
        reading("k8s.cgroup.net_net", "sent", -3.0, chart=chart("0a-1")),
        reading("k8s.cgroup.net_net", "received", 1.0, chart=chart("0a-1")),
        reading("k8s.cgroup.undefined", "x", 1.0, chart=chart("0a-1")),
        # no class segment, and an extra segment that is no container hash
        reading(cpu, "user", 50.0, chart="cgroup_k8s_kubepods_pod0a_aa.cpu"),
        reading(cpu, "user", 50.0, chart="x_" + chart("0a-1")),
        reading(cpu, "user", 50.0, chart="cgroup_k8s_kubepods_burstable_pod0a_aa_extra.cpu"),
    )
    found = {r.metric: r for r in silver.silver_table(rows, fixed.pod_metrics(spark)).collect()}
    assert set(found) == {"cpu_pct", "mem_mib", "net_kbps"}
    assert (found["cpu_pct"].value, found["cpu_pct"].n_samples) == (4.0, 2)
    assert found["mem_mib"].value == 7.0
    assert found["net_kbps"].value == -2.0
    assert (found["cpu_pct"].pod_uuid, found["cpu_pct"].qos_class) == ("pod0a-1", "burstable")


SILVER = (
    "kd string, test_type string, run int, hostname string, pod_uuid string, "
    "qos_class string, metric string, value double, units string, n_samples bigint"
)


def pod_row(pod, test="idle", run=1, host="node_1", metric="cpu_pct", value=1.0, kd="k0s"):
    return (kd, test, run, host, pod, "burstable", metric, value, "%", 3)


def test_classification_depends_on_the_pod_alone(spark):
    table = spark.createDataFrame(
        [
            pod_row("podA"),
            pod_row("podA", "dp_redis_density", host="node_2"),
            pod_row("podB", "dp_redis_density"),
            pod_row("podA", "dp_redis_density", kd="k3s"),
        ],
        SILVER,
    )
    found = {
        (r.kd, r.hostname, r.pod_uuid): (r.role, r.found_in_loaded)
        for r in overhead.pod_classification(table).collect()
    }
    assert found == {
        ("k0s", "node_1", "podA"): ("system", []),
        ("k0s", "node_2", "podA"): ("system", ["dp_redis_density"]),
        ("k0s", "node_1", "podB"): ("workload", ["dp_redis_density"]),
        ("k3s", "node_1", "podA"): ("workload", ["dp_redis_density"]),
    }


def test_loaded_overhead_has_no_zero_fill(spark):
    table = spark.createDataFrame(
        [
            pod_row("podA", run=1, value=2.0),
            pod_row("podB", run=1, value=3.0),
            pod_row("podA", run=3, value=7.0),
            pod_row("podX", run=2, value=100.0),
        ],
        SILVER,
    )
    roles = spark.createDataFrame(
        [("k0s", "podA", "system"), ("k0s", "podB", "system")],
        "kd string, pod_uuid string, role string",
    )
    rows = overhead.loaded_overhead(table, roles).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.mean, row.n_runs, row.n_pods) == (6.0, 2, 2)
    assert math.isclose(row.std, plain.stdev([5.0, 7.0]))


def test_idle_totals_and_single_run_deviation(spark):
    table = spark.createDataFrame([pod_row("podabcdefgh-1", value=2.0)], SILVER)
    idle = overhead.idle_overhead(table, overhead.pod_classification(table))
    row = idle.first()
    assert (row.std, row.n_runs, row.pod_label, row.role) == (None, 1, "abcdefgh", "system")
    total = overhead.idle_overhead_totals(idle).first()
    assert (total.total_mean, total.total_std) == (2.0, 0.0)
    shares = overhead.orchestration_tax(
        overhead.loaded_overhead(table, overhead.pod_classification(table)), fixed.nodes(spark)
    ).first()
    assert shares.orchestration_tax_pct == 0.5


# --- ranks and statistics ------------------------------------------------------------
def brute_ranks(values):
    return {
        v: sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in set(values)
    }


@pytest.mark.parametrize("hot", [False, True])
def test_ranks_across_slices(spark, many_slices, hot):
    rng = random.Random(11)
    rows = [("a", rng.randint(0, 60) / 4) for _ in range(600)]
    rows += [("b", rng.uniform(-5, 5)) for _ in range(301)]
    if hot:
        rows += [("a", 3.25)] * 900
    frame = spark.createDataFrame(rows, "g string, v double")
    found = ranks.rank_average_ties(frame, ["g"], "v").collect()
    for group in ("a", "b"):
        values = [v for g, v in rows if g == group]
        assert {r.v: r.mid_rank for r in found if r.g == group} == brute_ranks(values)
    medians = {r.g: r.median for r in ranks.exact_median(frame, ["g"], "v").collect()}
    for group in ("a", "b"):
        assert medians[group] == plain.median([v for g, v in rows if g == group])


def test_spearman_against_brute_force(spark, many_slices):
    rng = random.Random(5)
    pairs = [(x := rng.randint(0, 20), x + rng.randint(-15, 15)) for _ in range(500)]
    pairs += [(7, rng.randint(0, 400)) for _ in range(300)]
    frame = spark.createDataFrame(
        [("a", float(x), float(y)) for x, y in pairs], "g string, x double, y double"
    )
    row = statistics.spearman(frame, ["g"], "x", "y").first()
    rx, ry = brute_ranks([p[0] for p in pairs]), brute_ranks([p[1] for p in pairs])
    expected = plain.correlation([rx[x] for x, _ in pairs], [ry[y] for _, y in pairs])
    assert math.isclose(row.spearman_rho, expected, rel_tol=1e-12)
    assert row.n == 800


def test_spearman_limits(spark):
    rows = [
        *[("perfect", float(i), float(i * i)) for i in range(5)],
        *[("constant", 1.0, float(i)) for i in range(5)],
        ("short", 1.0, 2.0), ("short", 2.0, 1.0),
    ]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    for form in (statistics.spearman, statistics.spearman_of_systems):
        found = {
            r.g: (r.spearman_rho, r.p_value) for r in form(frame, ["g"], "x", "y").collect()
        }
        assert found["perfect"][1] == 0.0 and math.isclose(found["perfect"][0], 1.0)
        assert found["constant"] == (None, None) and found["short"] == (None, None)


def counted_lower_tail(n1, n2, u):
    """P(U <= u) by listing every order of the two samples."""
    hits = total = 0
    for places in itertools.combinations(range(n1 + n2), n1):
        total += 1
        hits += sum(place - i for i, place in enumerate(places)) <= u
    return hits / total


def test_mann_whitney_small_samples_are_exact(spark):
    samples = {
        "a": ([0.0, 1.0, 2.0, 3.0], [i + 0.5 for i in range(12)]),
        "b": ([1.0] * 4, [2.0] * 4),  # ties: asymptotic
        "c": ([1.0, 3.0, 5.0, 7.0, 9.0], [2.0, 4.0, 6.0, 8.0, 10.0]),
        "d": ([10.0, 9.0, 8.5], [1.0, 2.0, 9.5, 3.0]),
        "e": ([1.0], [0.0, 2.0]),
        "f": ([5.0], [1.0]),
        "g": ([1.0, 2.0], []),
        "h": ([4.0, 6.0], [1.0, 2.0, 3.0, 5.0, 7.0]),
    }
    rows = [(g, True, v) for g, (x, _) in samples.items() for v in x]
    rows += [(g, False, v) for g, (_, y) in samples.items() for v in y]
    frame = spark.createDataFrame(rows, "g string, first boolean, v double")
    found = {
        r.g: r
        for r in statistics.mann_whitney_less(frame, ["g"], "v", F.col("first")).collect()
    }
    assert set(found) == set(samples)
    assert found["c"].u_statistic == 10.0 and found["a"].u_statistic == 6.0
    assert found["b"].u_statistic == 0.0 and 0 < found["b"].p_value < 0.05
    assert found["g"].p_value is None and found["g"].u_statistic is None
    for g in ("a", "c", "d", "e", "f", "h"):
        x, y = samples[g]
        expected = counted_lower_tail(len(x), len(y), found[g].u_statistic)
        assert math.isclose(found[g].p_value, expected, rel_tol=1e-12)


def test_mann_whitney_exact_beside_a_large_sample(spark):
    """Eight against two thousand: the exact p is near the asymptotic one."""
    rows = [(True, 100.0 * i + 0.5) for i in range(8)] + [(False, float(i)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "first boolean, v double").withColumn("g", F.lit(1))
    row = statistics.mann_whitney_less(frame, ["g"], "v", F.col("first")).first()
    u, mean, deviation = row.u_statistic, 8000.0, math.sqrt(8 * 2000 * 2009 / 12)
    normal = 0.5 * math.erfc(-(u + 0.5 - mean) / deviation / math.sqrt(2))
    assert abs(row.p_value - normal) < 2e-3


def test_one_rank_pass_gives_tests_and_medians(spark, many_slices):
    """Comparisons of all kinds in one ranking agree with one ranking each."""
    r = random.Random(5)
    rows = [("t1", float(r.randrange(40)), r.random() < 0.4) for _ in range(300)]
    rows += [("t2", r.random(), i < 5) for i in range(60)]
    rows += [("m1", float(r.randrange(9)), None) for _ in range(101)] + [("m2", 4.0, None), ("m2", 7.0, None)]
    rows += [("t1", None, True), (None, 1.0, True), ("one", 2.0, True)]
    frame = spark.createDataFrame(rows, "g string, v double, first boolean")
    found = {x.g: x for x in statistics.rank_pass(frame, ["g"], "v", F.col("first")).collect()}
    assert set(found) == {"t1", "t2", "m1", "m2", "one"}
    for x in statistics.mann_whitney_less(frame, ["g"], "v", F.col("first")).collect():
        y = found[x.g]
        assert (x.n1, x.n2, x.u_statistic, x.p_value) == (y.n1, y.n2, y.u_statistic, y.p_value)
    for x in ranks.exact_median(frame, ["g"], "v").collect():
        values = [v for g, v, _ in rows if g == x.g and v is not None]
        assert found[x.g].median == x.median == plain.median(values) and found[x.g].n == len(values)
    assert found["m1"].p_value is None and found["one"].u_statistic is None


def order_counts(m, n):
    """Orders of m and n values by U: coefficients of the Gaussian binomial."""
    counts = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for at in range(m * n, n + i - 1, -1):
            counts[at] -= counts[at - n - i]
        for at in range(i, m * n + 1):
            counts[at] += counts[at - i]
    return counts


def test_exact_tail_against_counted_orders(spark):
    cases, expected = [], []
    for m in range(1, 9):
        for n in (m, m + 1, 23, 60):
            below, total = 0, math.comb(m + n, m)
            for u, count in enumerate(order_counts(m, n)):
                below += count
                if u % 11 == 0 or u < 3 or u > m * n - 3:
                    cases.append((m, n, u))
                    expected.append(below / total)
    frame = spark.createDataFrame(cases, "m bigint, n bigint, u bigint")
    found = [r[0] for r in frame.select(probability.exact_rank_sum_lower("m", "n", "u", 8)).collect()]
    assert all(math.isclose(f, e, rel_tol=1e-12) for f, e in zip(found, expected))


def test_exact_tail_of_ten_million(spark):
    """No work grows with the larger sample: small tails, the middle, and both ends."""
    n = 10_000_000
    cases = [(8, n, 3), (7, n + 1, (7 * (n + 1) - 1) // 2), (8, n, 8 * n), (8, n, 8 * n - 1), (3, n, n)]
    frame = spark.createDataFrame(cases, "m bigint, n bigint, u bigint")
    found = [r[0] for r in frame.select(probability.exact_rank_sum_lower("m", "n", "u", 8)).collect()]
    # 0 to 3 split into at most eight parts: 1 + 1 + 2 + 3 ways
    assert math.isclose(found[0], 7 / math.comb(n + 8, 8), rel_tol=1e-12)
    assert math.isclose(found[1], 0.5, rel_tol=1e-12)
    assert found[2] == 1.0 and found[3] == 1.0
    # j split into at most three parts: (j + 3)^2 / 12 ways, to the next whole number
    ways = sum(((j + 3) ** 2 + 6) // 12 for j in range(n + 1))
    assert math.isclose(found[4], ways / math.comb(n + 3, 3), rel_tol=1e-12)


def test_unlisted_names_are_not_lost(spark):
    rows = telemetry(
        spark,
        reading(fixed.CTX_SOFTIRQ, "TIMER", 6.0), reading(fixed.CTX_SOFTIRQ, "IRQ_POLL", 3.0),
        reading(fixed.CTX_SOFTIRQ, "NEW", 2.0), reading(fixed.CTX_SOFTIRQ, "NEWER", 1.0),
        reading(fixed.CTX_SOFTNET, "processed", 5.0), reading(fixed.CTX_SOFTNET, "fresh", 4.0),
        reading(fixed.CTX_CSTATE, "c9_acpi", 7.0),
    )
    wide = interrupts.softirq_wide(interrupts.softirq_breakdown(interrupts.softirq_runs(rows))).first()
    shares = [v for k, v in wide.asDict().items() if k.endswith("_proportion") and v is not None]
    assert math.isclose(sum(shares), 1.0) and wide.IRQ_POLL_mean == 3.0 and wide.other_mean == 3.0
    net = interrupts.softnet_summary(rows).first()
    assert (net.processed_mean, net.other_mean, net.other_max) == (5.0, 4.0, 4.0)
    assert interrupts.cstate_breakdown(rows, fixed.nodes(spark)).first().other_mean == 7.0


def test_moments_give_both_frequency_tables(spark):
    rng = random.Random(3)
    rows = telemetry(
        spark,
        *[
            reading(fixed.CTX_FREQ, "cpu0", rng.choice([None, rng.uniform(600, 1800)]), at=i % 7,
                    kd=rng.choice(["k0s", "k3s"]), run=rng.randrange(1, 4))
            for i in range(300)
        ],
    )
    moments = frequency.run_moments(rows)
    for direct, derived in (
        (frequency.freq_stats(rows), frequency.stats_of(moments)),
        (frequency.freq_below_threshold(rows), frequency.below_of(moments)),
    ):
        assert direct.columns == derived.columns
        pairs = zip(*[df.orderBy("kd", *direct.columns[1:2], "min_freq_mhz").collect() for df in (direct, derived)])
        for a, b in pairs:
            assert all(math.isclose(x, y, rel_tol=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b))


def test_runs_with_one_kind_of_interrupt_stay(spark):
    rows = telemetry(spark, reading(fixed.CTX_IRQ, "i", 40.0)).unionByName(
        telemetry(spark, reading(fixed.CTX_SOFTIRQ, "TIMER", 10.0)).withColumn("run", F.lit(2))
    )
    found = {r.run: r for r in interrupts.irq_cpu_overhead(interrupts.interrupt_runs(rows)).collect()}
    assert found[1].irq_rate == 40.0 and found[1].softirq_rate is None
    assert found[2].irq_rate is None and found[2].softirq_rate == 10.0
    assert all(r.total_cpu_overhead_pct > 0 for r in found.values())


def test_kruskal_does_not_depend_on_the_last_bits(spark):
    rows = [("k0s", 0.1 + 0.2), ("k0s", 1.0), ("k3s", 0.3), ("k3s", 2.0), ("k8s", 3.0)]
    nudged = [("k0s", 0.3), ("k0s", 1.0), ("k3s", 0.1 + 0.2), ("k3s", 2.0), ("k8s", 3.0)]
    results = [
        statistics.kruskal_wallis(
            spark.createDataFrame([("t", kd, v) for kd, v in sample], "t string, kd string, v double"),
            ["t"], "kd", "v",
        ).first().kruskal_h
        for sample in (rows, nudged, rows[::-1])
    ]
    assert len(set(results)) == 1


def test_decimals_round_the_binary_value(spark):
    values = [14.0172285, 5e-07, -5e-07, 800.5, 2.5, -3.25]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    texts = [r.x for r in sinks.fixed_decimals(frame.coalesce(1)).collect()]
    assert texts == ["%.6f" % v for v in values]
    whole = frame.coalesce(1).select(labels.fixed_text(F.col("x"), 0).alias("x")).collect()
    assert [r.x for r in whole] == ["%.0f" % v for v in values]


def test_series_rows_and_files_are_not_lost(spark, tmp_path):
    header = "hostname,value,timestamp\n"
    (tmp_path / "k0s-idle-1-cpu.csv").write_text(header + "node_1,text,1\nnode_2,96.5,102.5\nnode_3,95,3\n")
    (tmp_path / "k3s-idle-1-cpu.csv").write_text(header + "node_1,1,1\nnode_1,1,1,9\n")
    (tmp_path / "k3s-idle-2-cpu.csv").write_text(header + "node_1,97\n")
    rows = benchmarks.read_idle_series(spark, str(tmp_path)).collect()
    assert sorted((r.run, r.hostname, r.value, r.timestamp) for r in rows if r.kd == "k0s") == [
        ("k0s-idle-1", "node_1", None, 1), ("k0s-idle-1", "node_2", 96.5, None),
        ("k0s-idle-1", "node_3", 95.0, 3),
    ]
    assert [(r.run, r.value, r.timestamp) for r in rows if r.kd == "k3s"] == [("k3s-idle-2", 97.0, None)]
    refused = [r.file for r in benchmarks.refused_series_files(spark, str(tmp_path)).collect()]
    assert len(refused) == 1 and refused[0].endswith("k3s-idle-1-cpu.csv")


def test_broken_documents_are_an_error(spark, tmp_path):
    (tmp_path / "docs.json").write_text('{"timestamp": 1}\n{"timestamp": \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        documents.read_documents(spark, str(tmp_path), "json").collect()
    with pytest.raises(AnalysisException):
        documents.read_documents(spark, str(tmp_path / "absent"), required=True)


def test_time_bounds_reach_the_scan(spark, tmp_path):
    registry, docs = registry_and_documents(spark)
    path = str(tmp_path / "documents")
    sinks.write_documents(docs, path)
    stored = documents.read_documents(spark, path)
    plan = ingest.tag_hits(registry, stored)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(timestamp,0)" in plan and "LessThanOrEqual(timestamp,20000)" in plan
    assert "PartitionFilters: [isnotnull(day" in plan
    window = documents.read_stored_documents(spark, path, 1000, 9000)
    plan = documents.documents_of_tag(window, "idle-1", 1000, 9000)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and ".tag = idle-1)" in plan


def test_silver_folders_of_systems_that_are_gone_go(spark, tmp_path):
    row = {c: None for c in schemas.SILVER_COLUMNS}
    kinds = dict(sources.read_silver(spark, str(tmp_path / "none")).dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in schemas.SILVER_COLUMNS)
    path = str(tmp_path / "silver")
    for kds in (("k0s", "k3s"), ("k0s",)):
        rows = [tuple((row | {"kd": kd}).values()) for kd in kds]
        sinks.write_silver(spark.createDataFrame(rows, schema), path)
    assert [r.kd for r in sources.read_silver(spark, path).collect()] == ["k0s"]


def test_unknown_roles_and_gaps(spark):
    """What the registered queries do not meet: a system without classification, a missing test."""
    estimates = spark.createDataFrame(
        [("k0s", "idle", 800.5, 1.0, 0.1)],
        "kd string, test_type string, mean_freq_mhz double, mean_power_w double, std_power_w double",
    )
    grid = energy.completeness_matrix(estimates, fixed.published(spark)).collect()
    labels_found = {(r.kd, r.test_type): r.freq_label for r in grid}
    assert labels_found["k0s", "idle"] == "800" and labels_found["k0s", "dp_redis_density"] == "N/A"


def test_job_folder_goes_with_the_job(spark):
    with session.job_folder(spark, "job") as folder:
        table = session.written(spark.range(3), "table")
        assert table.count() == 3 and folder.rpartition("/")[2] in table.inputFiles()[0]
    with pytest.raises(AnalysisException):
        spark.read.parquet(folder)


def test_broadcast_limit_is_in_bytes(spark):
    wide = spark.range(10).select(*[F.lit("x").alias(f"c{i}") for i in range(50)])
    assert session.declared_width(wide.schema) > 50 * 64
    assert session.fits_broadcast(wide)


def test_trend_of_constant_is_null(spark):
    frame = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 3.0, 6.0), ("b", 1.0, 2.0), ("b", 1.0, 5.0)],
        "g string, x double, y double",
    )
    found = {r.g: r for r in statistics.linear_trend(frame, ["g"], "x", "y").collect()}
    assert (found["a"].slope, found["a"].intercept) == (2.0, 0.0)
    assert found["b"].slope is None


# --- ingest ----------------------------------------------------------------------------
FILES = "kd string, test_type string, run_dir string, file_name string, text string"


def test_registry_prefers_markers_but_not_zero(spark):
    log = '[change the tag to t-1] "msg": "100 - 160"'
    files = spark.createDataFrame(
        [
            ("k0s", "idle", "idle-1", "ansible_output_a.txt", log),
            ("k0s", "idle", "idle-1", "tmp-before.txt", "90\n"),
            ("k0s", "idle", "idle-1", "tmp-after.txt", "0"),
            ("k0s", "idle", "idle-2", "tmp-before.txt", "bad"),
            ("k0s", "idle", "odd", "ansible_output_a.txt", '"msg": "0 - 5"'),
        ],
        FILES,
    )
    found = {r.run_dir: r for r in ingest.run_registry(files).collect()}
    one = found["idle-1"]
    assert (one.tag, one.run_num, one.start_ts, one.end_ts, one.duration_s) == ("t-1", 1, 90, 160, 70)
    two = found["idle-2"]
    assert (two.tag, two.start_ts, two.end_ts, two.duration_s) == ("idle-2", None, None, None)
    odd = found["odd"]
    assert (odd.run_num, odd.start_ts, odd.duration_s) == (None, 0, None)
    coverage = ingest.registry_coverage(ingest.run_registry(files)).first()
    assert (coverage.n_runs, coverage.n_with_timestamps, coverage.n_missing) == (3, 2, 1)


def registry_and_documents(spark):
    registry = spark.createDataFrame(
        [
            ("k0s", "idle", "idle-1", 1, "idle-1", 1000, 9000, 8000),
            ("k3s", "idle", "idle-1", 1, "k3s-idle-1", 5000, 20000, 15000),
            ("k8s", "idle", "idle-1", 1, "gone", 0, 9, 9),
            ("k8s", "idle", "idle-2", 2, "idle-1", None, 9, None),
        ],
        schemas.REGISTRY,
    )
    stamps = [(tag, at) for tag in ("k0s-idle-1.", "idle-1", "x") for at in range(0, 25000, 500)]
    docs = spark.createDataFrame(
        [((tag,), at, "node_1", "c", "c", "f", "m", "m", "u", 1.0) for tag, at in stamps],
        schemas.DOCUMENTS,
    )
    return registry, docs


def test_resolve_and_extract(spark, monkeypatch):
    registry, docs = registry_and_documents(spark)

    def run():
        resolved = {r.kd: r.resolved_tag for r in ingest.tag_resolve(registry, docs).collect()}
        rows = sorted(
            (r.kd, r.run, r.relative_time) for r in ingest.extract_run(registry, docs).collect()
        )
        return resolved, rows

    resolved, rows = run()
    assert resolved == {"k0s": "idle-1", "k3s": "idle-1"}
    expected = [("k0s", 1, at - 1000) for at in range(1000, 9001, 500)]
    expected += [("k3s", 1, at - 5000) for at in range(5000, 20001, 500)]
    assert rows == sorted(expected)
    # the shuffled form for many windows gives the same rows
    monkeypatch.setattr(ingest, "rows_fit_broadcast", lambda *_: False)
    assert run() == (resolved, rows)


def test_manifest_states(spark):
    registry, docs = registry_and_documents(spark)
    requested = spark.createDataFrame(
        [("k0s", "idle", 1), ("k3s", "idle", 1), ("k8s", "idle", 1), ("k8s", "idle", 2)],
        "kd string, test_type string, run int",
    )
    profile = ingest.ingest_profile(ingest.extract_run(registry, docs))
    rows = ingest.manifest(
        requested, registry, ingest.tag_resolve(registry, docs), profile, requested.limit(1)
    )
    found = {(r.kd, r.run): (r.status, r.n_rows) for r in rows.collect()}
    assert found == {
        ("k0s", 1): ("skipped", None), ("k3s", 1): ("ok", 31),
        ("k8s", 1): ("tag_failed", None), ("k8s", 2): ("not_found", None),
    }


# --- files -------------------------------------------------------------------------------
def test_missing_paths_are_empty(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert sources.read_telemetry(spark, gone).count() == 0
    assert sources.read_run_files(spark, gone).count() == 0
    assert benchmarks.read_pod_startup(spark, gone).columns[1] == "kd"
    assert documents.read_run_logs(spark, gone).count() == 0
    assert sources.read_result_csv(spark, gone, "a int").count() == 0


def test_one_file_per_run(spark, tmp_path):
    rows = telemetry(spark, reading(fixed.CTX_CPU, "idle", 1.0), reading(fixed.CTX_CPU, "idle", 2.0))
    frame = rows.drop("kd", "test_type", "run").toPandas()
    (tmp_path / "k0s").mkdir()
    for name in ("idle_run1", "cp_heavy_12client_run12"):
        frame.to_parquet(tmp_path / "k0s" / f"{name}.parquet", index=False)
    found = sources.read_run_files(spark, str(tmp_path)).select("kd", "test_type", "run").distinct()
    assert sorted(map(tuple, found.collect())) == [("k0s", "cp_heavy_12client", 12), ("k0s", "idle", 1)]


def test_run_files_are_replaced_or_skipped(spark, tmp_path):
    path = str(tmp_path / "runs")
    old = telemetry(spark, *[reading(fixed.CTX_CPU, "idle", 1.0, at=a, run=r) for a in (5, 0) for r in (1, 2)])
    sinks.write_runs(old, path)
    new = telemetry(spark, *[reading(fixed.CTX_CPU, "idle", 9.0, run=r) for r in (2, 3)])
    sinks.write_runs(new, path, existing=sources.read_telemetry(spark, path))
    counts = {r.run: (r.n, r.v) for r in sources.read_telemetry(spark, path).groupBy("run").agg(
        F.count("*").alias("n"), F.max("value").alias("v")).collect()}
    assert counts == {1: (2, 1.0), 2: (2, 1.0), 3: (1, 9.0)}
    sinks.write_runs(new, path)
    counts = {r.run: r.n for r in sources.read_telemetry(spark, path).groupBy("run").agg(
        F.count("*").alias("n")).collect()}
    assert counts == {1: 2, 2: 1, 3: 1}


def test_hot_run_is_split_and_sorted_by_context(spark, tmp_path):
    """One run with nearly all rows is written by several tasks."""
    path = str(tmp_path / "runs")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        rows = spark.range(0, 120_000, 1, 8).select(
            (F.col("id") % 1000).alias("relative_time"), F.lit("node_1").alias("hostname"),
            F.concat(F.lit("system.m"), (F.col("id") % 7).cast("string")).alias("chart_context"),
            F.sha2(F.col("id").cast("string"), 256).alias("chart_id"),
            F.lit("system").alias("chart_family"), F.lit("a").alias("metric_id"),
            F.lit("a").alias("metric_name"), F.rand(1).alias("value"), F.lit("u").alias("units"),
            F.when(F.col("id") % 1000 == 999, "k3s").otherwise("k0s").alias("kd"),
            F.when(F.col("id") % 1000 == 998, "x").otherwise("idle").alias("test_type"),
            F.when(F.col("id") < 100, 2).otherwise(1).alias("run"),
        )
        sinks.write_runs(rows, path, by_context=True)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
    hot = list((tmp_path / "runs" / "kd=k0s" / "test_type=idle" / "run=1").glob("*.parquet"))
    assert len(hot) > 3
    stored = sources.read_telemetry(spark, path)
    assert stored.count() == 120_000
    contexts = spark.read.parquet(str(hot[0])).toPandas()["chart_context"].tolist()
    assert contexts == sorted(contexts)


def test_files_of_a_large_run_are_disjoint_ranges(spark, tmp_path, many_slices):
    path = str(tmp_path / "runs")
    rows = spark.range(0, 40_000, 1, 8).select(
        ((F.col("id") * 7919) % 5000).alias("relative_time"),
        F.concat(F.lit("node_"), (F.col("id") % 3).cast("string")).alias("hostname"),
        F.lit("system.cpu").alias("chart_context"), F.col("id").cast("string").alias("chart_id"),
        F.lit("system").alias("chart_family"), F.lit("idle").alias("metric_id"),
        F.lit("idle").alias("metric_name"), F.lit(1.0).alias("value"), F.lit("u").alias("units"),
        F.lit("k0s").alias("kd"), F.lit("idle").alias("test_type"),
        F.when(F.col("id") % 100 == 0, 2).otherwise(1).alias("run"),
    )
    sinks.write_runs(rows, path)
    files = sorted((tmp_path / "runs" / "kd=k0s" / "test_type=idle" / "run=1").glob("*.parquet"))
    assert len(files) > 3
    keys = ["relative_time", "hostname", "chart_context", "metric_id"]
    parts = [pq.read_table(f, columns=keys).to_pylist() for f in files]
    listed = [tuple(r[k] for k in keys) for part in parts for r in part]
    assert listed == sorted(listed) and len(listed) == 39_600
    # files outside a bound on time are told by their statistics alone
    stats = [pq.ParquetFile(f).metadata.row_group(0).column(0).statistics for f in files]
    assert sum(s.min <= 4900 <= s.max for s in stats) <= 2
    ordered = scans.sorted_runs(sources.read_telemetry(spark, path))
    seen = [tuple(r[k] for k in ("run", *keys)) for r in ordered.toLocalIterator()]
    assert seen == sorted(seen) and ordered.rdd.getNumPartitions() > 1


def test_silver_grows_by_the_runs_that_changed(spark, tmp_path):
    runs, states = str(tmp_path / "runs"), str(tmp_path / "states")
    definitions = fixed.pod_metrics(spark)
    source = Inputs(spark, SMALL).telemetry.where("kd = 'k0s' AND test_type = 'idle'")
    numbers = sorted(r.run for r in source.select("run").distinct().collect())
    first, second = numbers[0], numbers[1]

    def rows(*wanted, times=1.0):
        return source.where(F.col("run").isin(*wanted)).withColumn("value", F.col("value") * times)

    def grown():
        return sorted(map(repr, silver_states.silver_of(silver_states.read_states(spark, states), definitions).collect()))

    def full():
        return sorted(map(repr, silver.silver_table(sources.read_telemetry(spark, runs), definitions).collect()))

    def changed():
        return sorted(r.run for r in silver_states.grow_silver(spark, runs, states, definitions).collect())

    assert changed() == [] and grown() == []
    sinks.write_runs(rows(first), runs)
    assert changed() == [first] and grown() == full() != []
    before = grown()
    # a known run is not opened again: its files can hold anything
    folder = tmp_path / "runs" / "kd=k0s" / "test_type=idle" / f"run={first}"
    kept = {f: (f.read_bytes(), f.stat()) for f in folder.glob("*.parquet")}
    for f, (raw, stat) in kept.items():
        f.write_bytes(b"x" * len(raw))
        os.utime(f, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    sinks.write_runs(rows(second), runs)
    assert changed() == [second]
    for f, (raw, stat) in kept.items():
        f.write_bytes(raw)
        os.utime(f, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert grown() == full() and set(before) < set(grown())
    assert changed() == []
    # a replaced run, first by other values, then by one without containers
    sinks.write_runs(rows(first, times=2.0), runs)
    assert changed() == [first] and grown() == full()
    sinks.write_runs(telemetry(spark, reading(fixed.CTX_CPU, "idle", 1.0, kd="k0s", run=second)), runs)
    assert changed() == [second] and grown() == full()
    assert {r.run for r in silver_states.read_states(spark, states).select("run").distinct().collect()} == {first}


def test_shared_folder_follows_the_session(spark):
    folder = session.shared_folder(spark)
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (wanted or spark.sparkContext.getCheckpointDir())
    table = session.written(spark.range(5).toDF("a"), "numbers")
    assert table.count() == 5 and all(folder in name for name in table.inputFiles())
    assert session.fits_broadcast(table, 5) and not session.fits_broadcast(table, 4)


def test_partition_and_filter_pushdown(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.write_runs(telemetry(spark, reading(fixed.CTX_FREQ, "cpu0", 700.0)), path)
    plan = (
        frequency.worker_frequencies(sources.read_telemetry(spark, path))
        .where(F.col("kd") == "k0s").groupBy("kd").agg(F.avg("value"))
        ._jdf.queryExecution().toString()
    )
    assert "PartitionFilters: [isnotnull(kd" in plan
    assert "In(hostname" in plan and "EqualTo(chart_context" in plan
    assert "chart_family" not in plan.split("ReadSchema")[1]


def test_series_names_with_commas(spark, tmp_path):
    for name in ("k0s-idle-3,k0s-idle-4,-cpu", "k3s-idle-10-cpu", "idle-1-cpu", "k0s-idle-5-ram"):
        (tmp_path / f"{name}.csv").write_text("hostname,value,timestamp\nnode_1,96.5,1703024441\n")
    rows = benchmarks.read_idle_series(spark, str(tmp_path)).collect()
    assert sorted((r.kd, r.run, r.value) for r in rows) == [
        ("k0s", "k0s-idle-3,k0s-idle-4,", 96.5), ("k3s", "k3s-idle-10", 96.5),
    ]


def test_run_logs_in_plain_folders(spark, tmp_path):
    folder = tmp_path / "k0s" / "idle" / "idle-1"
    folder.mkdir(parents=True)
    (folder / "ansible_output_1.txt").write_text('[change the tag to x]\n"msg": "3 - 9"\n')
    (folder / "tmp-before.txt").write_text("4\n")
    row = ingest.run_registry(documents.read_run_logs(spark, str(tmp_path))).first()
    assert (row.kd, row.test_type, row.run_dir, row.tag, row.start_ts, row.end_ts) == (
        "k0s", "idle", "idle-1", "x", 4, 9,
    )


def test_zones_settle_tags_without_documents(spark, tmp_path):
    path, index = str(tmp_path / "documents"), str(tmp_path / "zones")
    times = {"a": [100, 5000, 90_000], "k0s-b": [3600, 7000], "c.": [200, 3000], "d": [10, 20]}
    rows = [
        ((tag,), at, "h", "c", "c", "c", "i", "i", "u", 1.0) for tag, listed in times.items() for at in listed
    ]
    sinks.write_documents(spark.createDataFrame([*rows, ((None,), 5, *rows[0][2:])], schemas.DOCUMENTS), path, index)
    windows = {
        1: ("a", 4000, 8000), 2: ("b", 3600, 3600), 3: ("c", 1, 250), 4: ("d", 21, 80_000), 5: ("a", 86_400, 95_000),
        6: ("none", 1, 100_000), 7: ("a", 90_001, 90_002), 8: ("b", 7100, 3000),
    }
    registry = spark.createDataFrame(
        [("k0s", "idle", f"idle-{n}", n, tag, start, end, end - start) for n, (tag, start, end) in windows.items()],
        schemas.REGISTRY,
    )
    stored, zones = documents.read_documents(spark, path), documents.read_zones(spark, index)
    want = sorted(ingest.tag_resolve(registry, stored).collect())
    assert {r.run_num: r.resolved_tag for r in want} == {1: "a", 2: "k0s-b", 3: "c.", 5: "a"}
    assert zones.where("tag = 'a'").count() == 3 and zones.where("tag IS NULL").count() == 0
    kept = {f: f.read_bytes() for f in (tmp_path / "documents").rglob("*.parquet")}
    for f in kept:
        f.write_bytes(b"no document")
    assert sorted(ingest.tag_resolve(registry, stored, zones).collect()) == want
    # a window between the ends of one zone opens the documents, of its day only
    narrow = spark.createDataFrame([("k0s", "idle", "idle-9", 9, "c", 300, 2900, 2600)], schemas.REGISTRY)
    wide = spark.createDataFrame([("k0s", "idle", "idle-9", 9, "c", 150, 3100, 2950)], schemas.REGISTRY)
    for f, raw in kept.items():
        if "day=0" in str(f):
            f.write_bytes(raw)
    by_day = spark.read.schema(schemas.DOCUMENTS + ", day bigint").parquet(path)
    assert ingest.tag_resolve(narrow, by_day, zones).collect() == []
    assert [r.resolved_tag for r in ingest.tag_resolve(wide, by_day, zones).collect()] == ["c."]


def test_long_logs_are_read_by_line(spark, tmp_path):
    """A log over many splits gives what its whole text gives, wherever the borders fall."""
    filler = [f'TASK {i} "changed": false, - {i}' for i in range(3000)]
    announced = ['"msg":', "", '  "100', " -", '160", more']
    logs = {
        "idle-1": [*filler[:1500], "[change the tag to first]", *announced, *filler, "[change the tag to x]", '"msg": "1 - 2"'],
        "idle-2": ['"msg":', "no window", '"7', "- 9\"", *filler, 'ok "msg":"30 -', '50"', '"msg": "1 - 2"'],
        "idle-3": ['"msg": "8', "- no", '9"', *filler, "-", '5"'],
        "idle-4": [*filler[:700], *announced[:2], *[""] * 2000, *announced[2:]],
    }
    for run, lines in logs.items():
        folder = tmp_path / "k0s" / "idle" / run
        folder.mkdir(parents=True)
        (folder / "ansible_output_1.txt").write_text("\n".join(lines))
        (folder / "ansible_output_2.txt").write_text("nothing here\n")
    (tmp_path / "k0s" / "idle" / "idle-3" / "tmp-before.txt").write_text("\n 4 \n\n")
    (tmp_path / "k0s" / "idle" / "idle-3" / "tmp-after.txt").write_text("4\n5\n")
    whole = sorted(ingest.run_registry(documents.read_run_logs(spark, str(tmp_path))).collect())
    found = {r.run_dir: (r.tag, r.start_ts, r.end_ts) for r in whole}
    assert found == {
        "idle-1": ("first", 100, 160), "idle-2": ("idle-2", 30, 50),
        "idle-3": ("idle-3", 4, None), "idle-4": ("idle-4", 100, 160),
    }
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4001", "977"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = documents.read_run_log_lines(spark, str(tmp_path))
            assert size == "128m" or lines.rdd.getNumPartitions() > 40
            assert sorted(ingest.registry_of(ingest.log_findings(lines)).collect()) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    gone = documents.read_run_log_lines(spark, str(tmp_path / "absent"))
    assert ingest.registry_of(ingest.log_findings(gone)).collect() == []


def test_json_arrays_and_duplicates(spark, tmp_path):
    entries = [
        {"kd": "k0s", "hostname": host, "pod_uuid": "podA", "qos_class": "b", "role": role,
         "classification_method": "m", "found_in_idle": True, "found_in_loaded": [], "contexts": ["c"]}
        for host, role in (("node_1", "system"), ("node_2", "workload"))
    ]
    path = tmp_path / "classes.json"
    path.write_text(json.dumps(entries, indent=2))
    read = sources.read_classification(spark, str(path), whole=True)
    assert [r.role for r in sources.classification_by_pod(read).collect()] == ["workload"]


def test_fixed_decimals_keep_null(spark):
    frame = spark.createDataFrame([(1.0, "a"), (None, "b")], "x double, y string")
    assert [r.x for r in sinks.fixed_decimals(frame).orderBy("y").collect()] == ["1.000000", None]

"""Rule-based verdicts on the six hypotheses.

Each function takes statistics rows (one row, or one row per system) and
returns one verdict row with named statistics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions.labels import fixed_text, graded, strength_score, verdict_text
from tidegauge.operators.comparisons import (
    group_mean_ratio,
    lightweight_flag,
    operation_rows,
)
from tidegauge.operators.statistics import spearman_of_systems
from tidegauge.session import written


def _verdict_struct(
    proposition_id: str, supported: Column, strength: Column, statistics: dict[str, str]
) -> Column:
    """A verdict as a struct: rule outcome plus the named statistics (name to column)."""
    direction, hypothesis = next(
        (d, h) for key, d, h in fixed.HYPOTHESES if key == proposition_id
    )
    pairs = [p for name, column in statistics.items() for p in (F.lit(name), F.col(column).cast("double"))]
    lines = [
        F.concat(
            F.lit(f"{name} = "),
            F.coalesce(fixed_text(F.col(column).cast("double"), 4), F.lit("n/a")),
        )
        for name, column in statistics.items()
    ]
    return F.struct(
        F.lit(proposition_id).alias("proposition_id"),
        F.lit(direction).alias("direction"),
        F.lit(hypothesis).alias("hypothesis"),
        supported.alias("supported"),
        strength.alias("strength"),
        verdict_text(supported, strength).alias("verdict"),
        F.array(*lines).alias("evidence"),
        F.create_map(*pairs).alias("statistics"),
    )


# What the verdicts correlate over systems: name and the two columns.
CORRELATED = {
    "cpu": ("security_pct", "idle_cpu_pct"),
    "ram": ("security_pct", "idle_ram_mib"),
    "svc_create": ("idle_cpu_pct", "median_ms"),
    "efficiency": ("dp_ops", "idle_cpu_inverse"),
    "setup": ("security_pct", "setup_hours"),
}


def _with_inverse_cpu(points: DataFrame) -> DataFrame:
    return points.withColumn("idle_cpu_inverse", F.try_divide(F.lit(1.0), F.col("idle_cpu_pct")))


def _pair_correlations(points: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    """_pair, spearman_rho, p_value, n over one row of points per system."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("_pair"),
                F.col(x).cast("double").alias("_a"),
                F.col(y).cast("double").alias("_b"),
            )
            for name, (x, y) in pairs.items()
        ]
    )
    return spearman_of_systems(points.select(F.inline(entries)), ["_pair"], "_a", "_b")


def system_correlations(points: DataFrame) -> DataFrame:
    """All correlations of the verdicts in one row, from one row of points per system.

    Columns that ``points`` lacks are taken as NULL, and so are their correlations.
    """
    known = _with_inverse_cpu(points)
    for column in {c for pair in CORRELATED.values() for c in pair}:
        if column not in known.columns:
            known = known.withColumn(column, F.lit(None).cast("double"))
    ranked = _pair_correlations(known, **CORRELATED)

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("_pair") == name, F.col(column)))

    return ranked.agg(
        *[of(name, "spearman_rho").alias(f"spearman_rho_{name}") for name in CORRELATED],
        *[of(name, "p_value").alias(f"spearman_p_{name}") for name in CORRELATED],
    )


FOOTPRINT = ["spearman_rho_cpu", "spearman_rho_ram", "spearman_p_cpu", "spearman_p_ram"]


def _p1() -> Column:
    cpu, ram = F.col("spearman_rho_cpu"), F.col("spearman_rho_ram")
    strength = graded(
        ((cpu > 0.7) & (ram > 0.7), "strong"),
        ((cpu > 0.4) | (ram > 0.4), "moderate"),
        ((cpu > 0.2) | (ram > 0.2), "weak"),
        otherwise="inconclusive",
    )
    supported = F.coalesce((cpu > 0.3) & (ram > 0.3), F.lit(False))
    return _verdict_struct("P1", supported, strength, {c: c for c in FOOTPRINT})


def _p2() -> Column:
    grown, rho = F.col("k0s_system_cpu_growth_factor"), F.col("spearman_rho_svc_create")
    supported = F.coalesce(grown > 3.0, F.lit(False)) | F.coalesce(rho > 0.3, F.lit(False))
    strength = graded((grown > 5.0, "strong"), (grown > 2.0, "moderate"), otherwise="weak")
    names = ["spearman_rho_svc_create", "k0s_system_cpu_growth_factor"]
    return _verdict_struct("P2", supported, strength, {c: c for c in names})


def _p3() -> Column:
    p, ratio = F.col("mann_whitney_p"), F.col("ratio_heavy_to_lw")
    faster = F.col("mean_lightweight_ms") < F.col("mean_heavy_ms")
    supported = F.coalesce((p < 0.05) & faster, F.lit(False))
    strength = graded(
        ((p < 0.01) & (ratio > 1.5), "strong"),
        (p < 0.05, "moderate"),
        (faster, "weak"),
        otherwise="inconclusive",
    )
    names = ["mann_whitney_U", "mann_whitney_p", "mean_lightweight_ms", "mean_heavy_ms", "ratio_heavy_to_lw"]
    return _verdict_struct("P3", supported, strength, {c: c for c in names})


def _p10() -> Column:
    spread = F.col("efficiency_spread")
    better = F.col("k3s_ops_per_cpu") > F.col("kubeedge_ops_per_cpu")
    strength = graded(
        (spread > 10, "strong"), (spread > 5, "moderate"), (spread > 2, "weak"),
        otherwise="inconclusive",
    )
    supported = F.coalesce(better & (spread > 3.0), F.lit(False))
    statistics = {
        "spearman_rho": "spearman_rho_efficiency",
        "spearman_p": "spearman_p_efficiency",
        "efficiency_spread": "efficiency_spread",
    }
    return _verdict_struct("P10", supported, strength, statistics)


def _p12() -> Column:
    rho = F.col("spearman_rho_setup")
    strength = graded((rho > 0.7, "strong"), (rho > 0.4, "moderate"), otherwise="weak")
    supported = F.coalesce(rho > 0.3, F.lit(False))
    statistics = {"spearman_rho": "spearman_rho_setup", "spearman_p": "spearman_p_setup"}
    return _verdict_struct("P12", supported, strength, statistics)


def _p14() -> Column:
    cpu, ram = F.col("spearman_rho_cpu"), F.col("spearman_rho_ram")
    strength = graded(
        ((cpu > 0.7) | (ram > 0.7), "strong"),
        ((cpu > 0.4) | (ram > 0.4), "moderate"),
        ((cpu > 0.2) | (ram > 0.2), "weak"),
        otherwise="inconclusive",
    )
    supported = F.coalesce((cpu > 0.3) | (ram > 0.3), F.lit(False))
    return _verdict_struct("P14", supported, strength, {c: c for c in FOOTPRINT})


def _rows_of(stats: DataFrame, *verdicts: Column) -> DataFrame:
    return stats.select(F.inline(F.array(*verdicts)))


def _growth_of(kd: str = "k0s", test: str = "cp_heavy_12client") -> Column:
    """The growth factor that decides the second hypothesis."""
    wanted = (F.col("kd") == kd) & (F.col("test_type") == test)
    return F.max(F.when(wanted, F.col("growth_factor"))).alias("k0s_system_cpu_growth_factor")


def _efficiency_of() -> list[Column]:
    def of(kd: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("kd") == kd, F.col("ops_per_cpu"))), F.lit(0.0))

    return [
        of("k3s").alias("k3s_ops_per_cpu"),
        of("kubeEdge").alias("kubeedge_ops_per_cpu"),
        F.max("efficiency_spread").alias("efficiency_spread"),
    ]


def _beside(*rows: DataFrame) -> DataFrame:
    """Global aggregates of one row each, side by side."""
    first, *others = [row.withColumn("_one", F.lit(1)) for row in rows]
    for other in others:
        first = first.join(other, "_one")
    return first.drop("_one")


def verdict_p1(correlations: DataFrame) -> DataFrame:
    """Security goes with idle CPU and idle RAM (both must hold)."""
    return _rows_of(correlations, _p1())


def verdict_p2(correlations: DataFrame, growth: DataFrame) -> DataFrame:
    """System CPU grows under load.

    ``growth`` has the growth factor per (kd, test), of which the k0s
    control-plane one decides.
    """
    return _rows_of(_beside(growth.agg(_growth_of()), correlations), _p2())


def verdict_p3(test: DataFrame, means: DataFrame) -> DataFrame:
    """Lightweight systems start pods faster.

    ``test`` is the one-row rank test, ``means`` the one-row group comparison.
    """
    named = test.select(
        F.col("u_statistic").alias("mann_whitney_U"), F.col("p_value").alias("mann_whitney_p")
    )
    return _rows_of(_beside(named, means), _p3())


def verdict_p10(correlations: DataFrame, efficiency: DataFrame) -> DataFrame:
    """Efficient systems do the same work at lower cost.

    ``efficiency`` has one row per system with operations per CPU and the spread.
    """
    return _rows_of(_beside(correlations, efficiency.agg(*_efficiency_of())), _p10())


def verdict_p12(correlations: DataFrame) -> DataFrame:
    """Security goes with set-up effort."""
    return _rows_of(correlations, _p12())


def verdict_p14(correlations: DataFrame) -> DataFrame:
    """A small footprint goes with weak security (either resource suffices)."""
    return _rows_of(correlations, _p14())


def verdict_samples(startup: DataFrame, api: DataFrame) -> DataFrame:
    """All samples that the verdicts rank: comparison, kd, value, is_first.

    Start-up and pod creation compare lightweight with heavy systems (kd is empty);
    service creation asks for a median per kd.
    """
    flag = lightweight_flag()

    def sample(rows: DataFrame, comparison: str, kd: Column, first: Column) -> DataFrame:
        return rows.select(
            F.lit(comparison).alias("comparison"), kd.alias("kd"),
            F.col("medians").cast("double").alias("value"), first.alias("is_first"),
        )

    compared = {"startup": startup, "pod_create": operation_rows(api, "pod", "create")}
    parts = [sample(rows.where(flag.isNotNull()), name, F.lit(""), flag) for name, rows in compared.items()]
    services = operation_rows(api, "service", "create")
    parts.append(sample(services, "svc_create", F.col("kd"), F.lit(None).cast("boolean")))
    return reduce(DataFrame.unionByName, parts)


def _facts(rows: DataFrame, **values: str) -> DataFrame:
    """(kd, fact, value) of the named columns, a row per system each."""
    entries = [
        F.struct(F.lit(name).alias("fact"), F.col(column).cast("double").alias("value"))
        for name, column in values.items()
    ]
    return rows.select("kd", F.inline(F.array(*entries)))


def verdict_statistics(
    ranked: DataFrame, startup: DataFrame, measured: DataFrame, system_cpu: DataFrame, published: DataFrame
) -> DataFrame:
    """Everything the six verdicts rest on, in one row.

    ``ranked`` is the rank pass over ``verdict_samples``, written; ``measured`` has
    idle_cpu_pct and idle_ram_mib per kd, ``system_cpu`` the mean system CPU per (kd,
    test).  Facts of a system meet in one aggregation, and what follows from them in a
    second one, so nothing is joined.
    """
    effort = startup.groupBy("kd").agg((F.avg("medians") / 3_600_000).alias("setup_hours"))
    tests = system_cpu.select("kd", F.concat(F.lit("system_"), "test_type").alias("fact"), F.col("mean").alias("value"))
    facts = [
        _facts(measured, idle_cpu_pct="idle_cpu_pct", idle_ram_mib="idle_ram_mib"),
        _facts(published, security_pct="security_pct", dp_ops="dp_ops"),
        _facts(ranked.where("comparison = 'svc_create'"), median_ms="median"),
        _facts(effort, setup_hours="setup_hours"),
        tests,
    ]
    idle, heavy = "system_idle", "system_cp_heavy_12client"
    names = [
        "idle_cpu_pct", "idle_ram_mib", "security_pct", "dp_ops", "median_ms", "setup_hours", idle, heavy,
    ]
    # a row per system, written: three branches read it
    systems = written(
        reduce(DataFrame.unionByName, facts)
        .groupBy("kd")
        .agg(*[F.max(F.when(F.col("fact") == name, F.col("value"))).alias(name) for name in names]),
        "systems",
    )
    # only systems that were measured and published are compared
    points = systems.where("idle_cpu_pct IS NOT NULL AND security_pct IS NOT NULL")
    pairs = _pair_correlations(_with_inverse_cpu(points), **CORRELATED)
    rho, p = F.concat(F.lit("spearman_rho_"), "_pair"), F.concat(F.lit("spearman_p_"), "_pair")
    derived = [
        pairs.select(
            F.lit("").alias("kd"),
            F.inline(
                F.array(
                    F.struct(rho.alias("fact"), F.col("spearman_rho").alias("value")),
                    F.struct(p.alias("fact"), F.col("p_value").alias("value")),
                )
            ),
        ),
        _facts(
            points.select("kd", F.try_divide("dp_ops", "idle_cpu_pct").alias("ops")), ops_per_cpu="ops"
        ),
        _facts(
            systems.where("kd = 'k0s'").select("kd", F.try_divide(heavy, idle).alias("growth")),
            k0s_system_cpu_growth_factor="growth",
        ),
        _facts(ranked.where("comparison = 'startup'"), mann_whitney_U="u_statistic", mann_whitney_p="p_value"),
        _facts(
            group_mean_ratio(startup).withColumn("kd", F.lit("")),
            **{name: name for name in ("mean_lightweight_ms", "mean_heavy_ms", "ratio_heavy_to_lw")},
        ),
    ]
    single = [f"spearman_{kind}_{pair}" for pair in CORRELATED for kind in ("rho", "p")]
    single += ["k0s_system_cpu_growth_factor", "mann_whitney_U", "mann_whitney_p"]
    single += ["mean_lightweight_ms", "mean_heavy_ms", "ratio_heavy_to_lw"]
    ops = F.when(F.col("fact") == "ops_per_cpu", F.col("value"))

    def of(kd: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("kd") == kd, ops)), F.lit(0.0))

    return reduce(DataFrame.unionByName, derived).agg(
        *[F.max(F.when(F.col("fact") == name, F.col("value"))).alias(name) for name in single],
        of("k3s").alias("k3s_ops_per_cpu"),
        of("kubeEdge").alias("kubeedge_ops_per_cpu"),
        (F.max(ops) / F.greatest(F.min(ops), F.lit(1.0))).alias("efficiency_spread"),
    )


def all_verdicts(statistics: DataFrame) -> DataFrame:
    """The six verdict rows from the one row of ``verdict_statistics``."""
    return _rows_of(statistics, _p1(), _p2(), _p3(), _p10(), _p12(), _p14())


def evidence_rows(proposition_id: str, name: str, rows: DataFrame, value: str) -> DataFrame:
    """One number per row of a result table: proposition, name, kd, test_type, value."""
    absent = F.lit(None).cast("string")
    columns = {
        "kd": F.col("kd") if "kd" in rows.columns else absent,
        "test_type": F.col("test_type") if "test_type" in rows.columns else absent,
    }
    return rows.select(
        F.lit(proposition_id).alias("proposition_id"),
        F.lit(name).alias("name"),
        *[column.cast("string").alias(key) for key, column in columns.items()],
        F.col(value).cast("double").alias("value"),
    )


def with_numbers(verdicts: DataFrame, numbers: DataFrame) -> DataFrame:
    """Verdicts with their numbers as an array of (name, kd, test_type, value).

    ``numbers`` has a row per result, system and test, so an array is that short.
    """
    entry = F.struct("name", "kd", "test_type", "value")
    listed = numbers.groupBy("proposition_id").agg(F.sort_array(F.collect_list(entry)).alias("numbers"))
    return verdicts.join(listed, "proposition_id", "left")


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """How many hypotheses are supported, and the mean strength score."""
    return verdicts.agg(
        F.count_if(F.col("supported")).alias("n_supported"),
        F.count("*").alias("n_total"),
        F.avg(strength_score(F.col("strength"))).alias("mean_strength"),
    )

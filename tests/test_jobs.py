"""The batch jobs end to end on the smallest tables."""

from pyspark.sql import functions as F

from tidegauge.operators import overhead
from tidegauge.plans import jobs
from tidegauge.plans.inputs import Inputs
from tidegauge.plans.scan_queries import idle_series
from tidegauge.sinks import tables as sinks
from tidegauge.sources import telemetry as sources

FOLDER = "/root/testdata/sf0.001"


def rows_of(spark, path):
    return spark.read.option("header", True).csv(str(path)).collect()


def test_ingest_job_skips_what_exists(spark, tmp_path):
    t = Inputs(spark, FOLDER)
    requested = t.metric_docs.select(
        "kd", F.lit("idle").alias("test_type"), "run"
    ).distinct().where("kd <> 'k8s'")
    jobs.run_ingest(t.run_files, t.documents, requested.where("run < 3"), str(tmp_path))
    first = sources.read_telemetry(spark, f"{tmp_path}/runs")
    assert {r.run for r in first.select("run").distinct().collect()} == {1, 2}
    before = first.count()
    jobs.run_ingest(t.run_files, t.documents, requested, str(tmp_path))
    states = {
        (r.kd, r.run): r.status
        for r in spark.read.json(f"{tmp_path}/extraction_manifest").collect()
    }
    assert states["k0s", 1] == "skipped" and states["k0s", 4] == "ok"
    assert states["openYurt", 3] == "tag_failed" and states["openYurt", 5] == "not_found"
    assert sources.read_telemetry(spark, f"{tmp_path}/runs").count() > before
    sizes = spark.read.json(f"{tmp_path}/extraction_manifest").where("status = 'ok'").collect()
    assert all(r.file_kb > 0 and r.n_files >= 1 for r in sizes)


def test_energy_job(spark, tmp_path):
    jobs.run_energy(Inputs(spark, FOLDER).telemetry, str(tmp_path))
    assert len(rows_of(spark, tmp_path / "energy_estimates")) == 15
    assert len(rows_of(spark, tmp_path / "frequency_latency")) == 4
    amplification = rows_of(spark, tmp_path / "interrupt_amplification")
    assert all(
        float(r.amplification_factor) == 1.0 for r in amplification if r.test_type == "idle"
    )
    breakdown = rows_of(spark, tmp_path / "softirq_breakdown")
    for row in breakdown:
        shares = [float(v) for k, v in row.asDict().items() if k.endswith("_proportion") and v]
        assert abs(sum(shares) - 1) < 1e-9


def test_growing_overhead_equals_the_whole(spark, tmp_path):
    telemetry = Inputs(spark, FOLDER).telemetry
    runs, states = f"{tmp_path}/runs", f"{tmp_path}/states"
    for part, out in ((F.col("run") < 3, "first"), (F.col("run") >= 3, "grown")):
        sinks.write_runs(telemetry.where(part), runs)
        jobs.run_growing_overhead(spark, runs, states, f"{tmp_path}/{out}")
    jobs.run_overhead(telemetry, f"{tmp_path}/whole")
    for name in ("loaded_overhead", "idle_overhead_totals", "role_counts", "orchestration_tax"):
        whole, grown = (sorted(map(tuple, rows_of(spark, tmp_path / out / name)), key=str) for out in ("whole", "grown"))
        assert len(whole) == len(grown) > 0
        for x, y in zip(whole, grown):
            assert all(a == b or abs(float(a) - float(b)) < 2e-6 for a, b in zip(x, y))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("silver_", "classes_"))]


def test_bucketed_joins_do_not_shuffle(spark, tmp_path):
    silver = Inputs(spark, FOLDER).stored_silver
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_pod = ["kd", "pod_uuid"]
        with sinks.bucketed(silver, "silver", by_pod) as table:
            with sinks.bucketed(overhead.pod_classification(silver), "classes", by_pod) as classes:
                joined = overhead.join_role(table, classes)
                plan = joined._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" in plan and "Exchange" not in plan
                plain = overhead.join_role(silver, overhead.pod_classification(silver))
                assert sorted(map(str, joined.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
                assert table.inputFiles() and len(table.inputFiles()) <= 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_overhead_job(spark, tmp_path):
    jobs.run_overhead(Inputs(spark, FOLDER).telemetry, str(tmp_path))
    silver = sources.read_silver(spark, f"{tmp_path}/silver")
    classes = sources.read_classification(spark, f"{tmp_path}/pod_classification")
    pods = {tuple(r) for r in silver.select("kd", "hostname", "pod_uuid").distinct().collect()}
    assert pods == {tuple(r) for r in classes.select("kd", "hostname", "pod_uuid").collect()}
    assert {r.role for r in classes.select("role").distinct().collect()} == {"system", "workload"}
    assert len(rows_of(spark, tmp_path / "orchestration_tax")) == 30


def test_hypotheses_job(spark, tmp_path):
    t = Inputs(spark, FOLDER)
    growth = spark.createDataFrame(
        [("k0s", "cp_heavy_12client", 9.2)], "kd string, test_type string, growth_factor double"
    )
    jobs.run_hypotheses(spark, t.pod_startup, t.api_latency, growth, idle_series(t), str(tmp_path))
    found = {r.proposition_id: r.verdict for r in rows_of(spark, tmp_path / "proposition_validation")}
    assert set(found) == {"P1", "P2", "P3", "P10", "P12", "P14"}
    assert found["P1"] == found["P2"] == "SUPPORTED (strong)"
    summary = rows_of(spark, tmp_path / "verdict_summary")[0]
    assert summary.n_total == "6"
    numbers = rows_of(spark, tmp_path / "verdict_numbers")
    names = {r.name for r in numbers}
    assert {"startup_at_scale_ms", "service_create_median_ms", "slowdown", "growth_factor",
            "pod_create_mann_whitney_p", "mean_edge_max_ms", "ops_per_cpu"} <= names
    details = {r.proposition_id: r for r in spark.read.json(f"{tmp_path}/proposition_details").collect()}
    assert details["P3"].statistics["mann_whitney_U"] > 0
    assert {n.name for n in details["P2"].numbers} >= {"startup_at_scale_ms", "slowdown"}

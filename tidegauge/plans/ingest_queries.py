"""Ingest queries: log parsing, registry, tag resolution, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import tags
from tidegauge.operators import ingest
from tidegauge.plans.inputs import METRIC_DOCS, RUN_FILES, TELEMETRY
from tidegauge.plans.registry import query
from tidegauge.session import broadcast_if_small, checkpointed, new_table_path
from tidegauge.sinks import tables as sinks
from tidegauge.sources import documents

# --- expressions over log texts -----------------------------------------------


@query(
    "parse_run_log_tag", ctes=METRIC_DOCS,
    sql="SELECT kd, run, timestamp, CASE WHEN id <> 'error' THEN rtrim(tag, '*,') END AS log_tag FROM metric_docs",
)
def parse_run_log_tag(t):
    text = F.when(
        F.col("id") != "error",
        F.concat(F.lit("ok: [change the tag to "), F.col("tag"), F.lit(",**] done")),
    ).otherwise(F.lit("no tag here"))
    return t.metric_docs.select("kd", "run", "timestamp", tags.log_tag(text).alias("log_tag"))


@query(
    "parse_run_log_window", ctes=METRIC_DOCS,
    sql="""SELECT kd, run, CASE WHEN id <> 'error' THEN timestamp END AS log_start,
      CASE WHEN id <> 'error' THEN timestamp + 300 END AS log_end FROM metric_docs""",
)
def parse_run_log_window(t):
    text = F.when(
        F.col("id") != "error",
        F.format_string('ok: {\n "msg":  "%d - %d" }', "timestamp", F.col("timestamp") + 300),
    ).otherwise(F.lit('"msg": "none"'))
    return t.metric_docs.select(
        "kd", "run", tags.log_window(text, 1).alias("log_start"),
        tags.log_window(text, 2).alias("log_end"),
    )


@query(
    "parse_marker_time", ctes=METRIC_DOCS,
    sql="SELECT kd, run, CASE WHEN id <> 'error' THEN timestamp END AS marker FROM metric_docs",
)
def parse_marker_time(t):
    text = F.when(F.col("id") != "error", F.format_string(" %d\t\n", "timestamp")).otherwise(
        F.format_string("%d?", "timestamp")
    )
    return t.metric_docs.select("kd", "run", tags.marker_second(text).alias("marker"))


@query(
    "parse_run_number", ctes=METRIC_DOCS,
    sql="""SELECT kd, timestamp, CASE WHEN id <> 'error' THEN run END AS run_num FROM metric_docs""",
)
def parse_run_number(t):
    name = F.when(F.col("id") != "error", F.format_string("cp_light_1client-%d", "run")).otherwise(
        F.format_string("idle-%dx", "run")
    )
    return t.metric_docs.select("kd", "timestamp", tags.run_number(name).alias("run_num"))


CANDIDATES = """list_filter([tag,
      CASE WHEN right(tag, 1) <> '.' THEN tag || '.' END,
      CASE WHEN left(tag, len(kd) + 1) <> kd || '-' THEN kd || '-' || tag END,
      CASE WHEN left(tag, len(kd) + 1) <> kd || '-' THEN kd || '-' || tag || '.' END,
      CASE WHEN left(tag, len(kd) + 1) = kd || '-' THEN substr(tag, len(kd) + 2) END,
      CASE WHEN contains(tag, ',') THEN replace(tag, ',', '.') || '.' END,
      CASE WHEN contains(tag, ',') THEN replace(tag, ',', '.') END], lambda x: x IS NOT NULL)"""


@query(
    "tag_candidates", ctes=METRIC_DOCS,
    sql=f""", spelled AS (
      SELECT kd, CASE WHEN id = 'click' THEN tag || ',' || tag ELSE tag END AS tag FROM metric_docs
    ), listed AS (SELECT kd, tag, {CANDIDATES} AS c FROM spelled
    ), unfolded AS (SELECT kd, tag, CAST(unnest(range(len(c))) AS INT) AS position, c FROM listed)
    SELECT kd, tag, position, c[position + 1] AS candidate, count(*) AS n FROM unfolded GROUP BY ALL""",
)
def tag_candidates(t):
    spelled = F.when(
        F.col("id") == "click", F.concat("tag", F.lit(","), "tag")
    ).otherwise(F.col("tag"))
    rows = ingest.tag_candidates(t.metric_docs.select("kd", spelled.alias("tag")))
    return rows.groupBy("kd", "tag", "position", "candidate").agg(F.count("*").alias("n"))


# --- registry -------------------------------------------------------------------
REGISTRY = RUN_FILES.rstrip() + """, requested AS (
  SELECT DISTINCT kd, 'idle' AS test_type, run FROM metric_docs
)"""


def stored_logs(t):
    """Logs and markers as text files in run folders."""
    path = new_table_path(t.spark, "logs")
    rows = t.run_files.select("kd", "test_type", "run_dir", "file_name", "text")
    rows.write.partitionBy("kd", "test_type", "run_dir", "file_name").text(path)
    return path


def registry(t):
    return ingest.run_registry(t.run_files)


@query(
    "run_registry", ctes=RUN_FILES,
    sql="SELECT *, end_ts - start_ts AS duration_s FROM run_registry",
)
def run_registry(t):
    return ingest.registry_of(ingest.log_findings(documents.read_run_log_lines(t.spark, stored_logs(t))))


@query(
    "src_run_log_lines", ctes=RUN_FILES,
    sql="""SELECT * FROM (
      SELECT kd, test_type, run_dir, file_name, unnest(string_split(text, chr(10))) AS line FROM files
    ) WHERE trim(line) <> ''""",
)
def src_run_log_lines(t):
    lines = documents.read_run_log_lines(t.spark, stored_logs(t))
    return lines.select("kd", "test_type", "run_dir", "file_name", "line")


@query(
    "registry_coverage", ctes=RUN_FILES,
    sql="""SELECT kd, test_type, count(*) AS n_runs, count(start_ts) AS n_with_timestamps,
      min(end_ts - start_ts) AS min_duration_s, max(end_ts - start_ts) AS max_duration_s,
      count(*) FILTER (start_ts IS NULL) AS n_missing FROM run_registry GROUP BY kd, test_type""",
)
def registry_coverage(t):
    return ingest.registry_coverage(registry(t))


def requested(t):
    return t.metric_docs.select("kd", F.lit("idle").alias("test_type"), "run").distinct()


@query(
    "join_registry", ctes=REGISTRY,
    sql="""SELECT r.kd, r.test_type, r.run AS run_num, g.run_dir, g.tag, g.start_ts, g.end_ts,
      g.end_ts - g.start_ts AS duration_s
    FROM requested r JOIN run_registry g ON r.kd = g.kd AND r.test_type = g.test_type AND r.run = g.run_num""",
)
def join_registry(t):
    return ingest.join_registry(requested(t).withColumnRenamed("run", "run_num"), registry(t))


# --- documents ------------------------------------------------------------------
HITS = RUN_FILES.rstrip() + f""", listed AS (SELECT *, {CANDIDATES} AS c FROM run_registry
), probes AS (SELECT *, unnest(range(len(c))) AS position FROM listed
), hits AS (
  SELECT p.kd, p.test_type, p.run_num, CAST(p.position AS INT) AS position, p.c[p.position + 1] AS candidate FROM probes p
  WHERE EXISTS (SELECT 1 FROM metric_docs d WHERE d.tag = p.c[p.position + 1]
    AND d.timestamp BETWEEN p.start_ts AND p.end_ts)
), resolved AS (
  SELECT kd, test_type, run_num, arg_min(candidate, position) AS resolved_tag FROM hits GROUP BY ALL
), extracted AS (
  SELECT g.kd, g.test_type, g.run_num AS run, d.timestamp - g.start_ts AS relative_time, d.hostname,
    d.chart_context, d.chart_id, d.chart_family, d.id AS metric_id, d.name AS metric_name, d.value, d.units
  FROM resolved r JOIN run_registry g USING (kd, test_type, run_num)
  JOIN metric_docs d ON d.tag = r.resolved_tag AND d.timestamp BETWEEN g.start_ts AND g.end_ts
)
"""


def stored_documents(t):
    """Documents stored by day, and the index of their zones."""
    path, zones = new_table_path(t.spark, "documents"), new_table_path(t.spark, "zones")
    sinks.write_documents(t.documents, path, zones)
    return documents.read_documents(t.spark, path), documents.read_zones(t.spark, zones)


@query("exists_limit1", ctes=HITS, sql="SELECT * FROM hits")
def exists_limit1(t):
    stored, zones = stored_documents(t)
    return ingest.tag_hits_by_zones(checkpointed(registry(t)), zones, stored)


@query("document_zones", ctes=METRIC_DOCS, sql="""SELECT tag, timestamp // 3600 AS hour,
      min(timestamp) AS least_ts, max(timestamp) AS greatest_ts
    FROM metric_docs WHERE tag IS NOT NULL GROUP BY ALL""")
def document_zones(t):
    return stored_documents(t)[1]


@query("tag_resolve", ctes=HITS, sql="SELECT * FROM resolved")
def tag_resolve(t):
    return ingest.tag_resolve(checkpointed(registry(t)), t.documents)


@query("extract_run", ctes=HITS, sql="SELECT * FROM extracted")
def extract_run(t):
    return ingest.extract_run(checkpointed(registry(t)), t.documents)


@query(
    "relative_time", ctes=RUN_FILES,
    sql="""SELECT d.kd, d.run, d.hostname, d.id, d.value, d.timestamp - g.start_ts AS relative_time
    FROM metric_docs d JOIN run_registry g ON d.kd = g.kd AND d.run = g.run_num""",
)
def relative_time(t):
    starts = checkpointed(
        registry(t).select("kd", F.col("run_num").alias("run"), "start_ts")
    )
    rows = t.metric_docs.select("kd", "run", "hostname", "id", "value", "timestamp")
    return ingest.relative_time(rows.join(broadcast_if_small(starts), ["kd", "run"]))


PROFILE = """SELECT kd, test_type, run, count(*) AS n_rows, count(DISTINCT chart_context) AS n_contexts,
      count(DISTINCT (chart_context, metric_id)) AS n_metrics, count(DISTINCT hostname) AS n_hosts,
      max(relative_time) AS max_time_s FROM {table} GROUP BY kd, test_type, run"""


@query("ingest_profile", ctes=TELEMETRY, sql=PROFILE.format(table="telemetry"))
def ingest_profile(t):
    return ingest.ingest_profile(t.telemetry)


@query(
    "sink_manifest",
    ctes=HITS.rstrip() + f""", profile AS ({PROFILE.format(table="extracted")}
), requested AS (SELECT DISTINCT kd, 'idle' AS test_type, run FROM metric_docs
), statuses AS (
  SELECT q.*, CASE WHEN g.kd IS NULL THEN 'not_found'
      WHEN r.kd IS NULL THEN 'tag_failed' ELSE 'ok' END AS status, g.end_ts - g.start_ts AS d
  FROM requested q LEFT JOIN run_registry g ON q.kd = g.kd AND q.run = g.run_num
  LEFT JOIN resolved r ON q.kd = r.kd AND q.run = r.run_num
)
""",
    sql="""SELECT s.kd, s.test_type, s.run, s.status, p.n_rows, p.n_contexts, p.n_metrics, p.n_hosts,
      CASE WHEN s.status = 'ok' THEN s.d END AS duration_s
    FROM statuses s LEFT JOIN profile p ON s.status = 'ok' AND s.kd = p.kd AND s.run = p.run""",
)
def sink_manifest(t):
    entries = checkpointed(registry(t))
    resolved = checkpointed(ingest.tag_resolve(entries, t.documents))
    profile = ingest.ingest_profile(ingest.extract_resolved(entries, resolved, t.documents))
    path = new_table_path(t.spark, "manifest")
    rows = ingest.manifest(requested(t), entries, resolved, profile)
    sinks.write_json(rows, path)
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return t.spark.read.schema(schema).json(path)

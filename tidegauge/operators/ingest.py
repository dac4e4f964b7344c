"""From run logs and raw documents to telemetry, for all runs in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge.functions import tags
from tidegauge.session import checkpointed, rows_fit_broadcast

ENTRY = ["kd", "test_type", "run_num"]
SECONDS_PER_DAY = 86_400
BUCKET_SECONDS = 3600


def run_registry(files: DataFrame) -> DataFrame:
    """One entry per run directory from its log and marker files.

    ``files`` has kd, test_type, run_dir, file_name and the whole text.  Marker
    files win over the log; a zero in a marker counts as missing.  Without a
    tag in the logs the directory name is the tag.
    """
    name, text = F.col("file_name"), F.col("text")
    is_log = F.startswith(name, F.lit(fixed.LOG_PREFIX))
    read = files.select(
        "kd", "test_type", "run_dir", name,
        F.when(is_log, tags.log_tag(text)).alias("log_tag"),
        F.when(is_log, tags.log_window(text, 1)).alias("log_start"),
        F.when(is_log, tags.log_window(text, 2)).alias("log_end"),
        F.when(name == fixed.START_MARKER, tags.marker_second(text)).alias("file_start"),
        F.when(name == fixed.END_MARKER, tags.marker_second(text)).alias("file_end"),
    )
    return registry_of(read)


FOUND = ["log_tag", "log_start", "log_end", "file_start", "file_end"]


def log_findings(lines: DataFrame) -> DataFrame:
    """What every log and marker file says, from its lines (``read_run_log_lines``).

    One aggregation per split keeps its first tag, its first and last place and the few
    lines that can be part of a window.  Those that follow each other, also over the
    border of two splits, are put together, since a window may run over lines; the first
    one that matches counts.  No file is gathered whole.
    """
    file = ["kd", "test_type", "run_dir", "file_name"]
    name, line, place = F.col("file_name"), F.col("line"), F.col("place")
    is_log = F.startswith(name, F.lit(fixed.LOG_PREFIX))
    tag = F.when(is_log, tags.log_tag(line))
    held = F.when(~is_log | tags.may_hold_window(line), F.struct("place", "line"))
    blocks = lines.groupBy(*file, "part", "block").agg(
        F.min("place").alias("first"),
        F.max("place").alias("last"),
        F.min_by(tag, F.when(tag.isNotNull(), place)).alias("tag"),
        F.collect_list(held).alias("held"),
    )
    # one row per split of a file
    order = Window.partitionBy(*file).orderBy("part", "block")
    numbered = blocks.withColumn("number", F.row_number().over(order))
    tagged = numbered.groupBy(*file).agg(
        F.min_by("tag", F.when(F.col("tag").isNotNull(), F.col("number"))).alias("log_tag")
    )
    # and of these, only lines that can be part of a window
    within = Window.partitionBy(*file).orderBy("number", "place")
    previous = F.lag(F.struct("number", "place", "last")).over(within)
    follows = ((F.col("previous.number") == F.col("number")) & (F.col("previous.place") + 1 == place)) | (
        (F.col("previous.number") + 1 == F.col("number"))
        & (F.col("previous.place") == F.col("previous.last"))
        & (place == F.col("first"))
    )
    pieces = (
        numbered.select(*file, "number", "first", "last", F.inline("held"))
        .withColumn("previous", previous)
        .withColumn("chain", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(within))
    )
    sorted_lines = F.sort_array(F.collect_list(F.struct("number", "place", "line")))
    texts = pieces.groupBy(*file, "chain").agg(
        F.array_join(F.transform(sorted_lines, lambda x: x["line"]), "\n").alias("text")
    )
    text = F.col("text")
    start = F.when(is_log, tags.log_window(text, 1))
    read = texts.groupBy(*file).agg(
        F.min_by(start, F.when(start.isNotNull(), F.col("chain"))).alias("log_start"),
        F.min_by(tags.log_window(text, 2), F.when(start.isNotNull(), F.col("chain"))).alias("log_end"),
        # a marker of several filled lines is no number
        F.when(F.count("*") == 1, F.max(tags.marker_second(text))).alias("_second"),
    )
    return read.join(tagged, file, "full").select(
        *file, "log_tag", "log_start", "log_end",
        F.when(name == fixed.START_MARKER, F.col("_second")).alias("file_start"),
        F.when(name == fixed.END_MARKER, F.col("_second")).alias("file_end"),
    )


def registry_of(read: DataFrame) -> DataFrame:
    """One entry per run directory from what its files say (``FOUND`` per file)."""
    name = F.col("file_name")
    # a NULL ordering key takes the row out of min_by and max_by
    per_dir = read.groupBy("kd", "test_type", "run_dir").agg(
        F.min_by("log_tag", F.when(F.col("log_tag").isNotNull(), name)).alias("log_tag"),
        F.max_by("log_start", F.when(F.col("log_start").isNotNull(), name)).alias("log_start"),
        F.max_by("log_end", F.when(F.col("log_start").isNotNull(), name)).alias("log_end"),
        F.max("file_start").alias("file_start"),
        F.max("file_end").alias("file_end"),
    )
    start = F.coalesce(F.nullif(F.col("file_start"), F.lit(0)), "log_start")
    end = F.coalesce(F.nullif(F.col("file_end"), F.lit(0)), "log_end")
    both = (F.col("start_ts") != 0) & (F.col("end_ts") != 0)
    return (
        per_dir.withColumn("start_ts", start)
        .withColumn("end_ts", end)
        .select(
            "kd", "test_type", "run_dir",
            tags.run_number(F.col("run_dir")).alias("run_num"),
            F.coalesce("log_tag", "run_dir").alias("tag"),
            "start_ts", "end_ts",
            F.when(both, F.col("end_ts") - F.col("start_ts")).alias("duration_s"),
        )
    )


def registry_coverage(registry: DataFrame) -> DataFrame:
    """Per (kd, test): runs, runs with a start, shortest and longest duration."""
    lasting = F.when(F.col("duration_s") != 0, F.col("duration_s"))
    return registry.groupBy("kd", "test_type").agg(
        F.count("*").alias("n_runs"),
        F.count("start_ts").alias("n_with_timestamps"),
        F.min(lasting).alias("min_duration_s"),
        F.max(lasting).alias("max_duration_s"),
        F.count_if(F.col("start_ts").isNull()).alias("n_missing"),
    )


def usable_runs(registry: DataFrame) -> DataFrame:
    """The entry to use for every (kd, test, run): it has a start.

    Where two directories carry the same number the first by name is used.
    """
    entry = F.struct("run_dir", "tag", "start_ts", "end_ts", "duration_s")
    return (
        registry.where(F.col("start_ts").isNotNull() & F.col("run_num").isNotNull())
        .groupBy(*ENTRY)
        .agg(F.min_by(entry, "run_dir").alias("_entry"))
        .select(*ENTRY, "_entry.*")
    )


def join_registry(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested runs that the registry can serve."""
    return requested.join(usable_runs(registry), ENTRY)


def tag_candidates(registry: DataFrame) -> DataFrame:
    """One row per candidate spelling with its position."""
    return registry.select(
        "*", F.posexplode(tags.tag_candidates(F.col("tag"), F.col("kd"))).alias(
            "position", "candidate"
        )
    )


def stored_day(documents: DataFrame) -> list[str]:
    """The day column of documents that are stored by day."""
    return [name for name in documents.columns if name == "day"]


def documents_in_windows(
    documents: DataFrame, windows: DataFrame, existence: bool = False
) -> DataFrame:
    """Documents whose tag and time fall into a window.

    The earliest start and latest end of all windows bound the scan.  With
    ``existence`` only (tag, time) matters, and before a shuffle documents are
    folded to distinct pairs on the map side.

    ``windows`` has ``candidate``, ``start_ts``, ``end_ts`` and any other
    columns.  A small window table is broadcast and the documents stream past
    it.  A larger one is unfolded into hours and joined on (tag, hour): each
    document has one hour, so no pair is found twice, and a tag that holds a
    large part of all documents is spread over its hours.
    """
    tagged = documents.withColumn("candidate", F.col("labels.tag"))
    bounds = windows.agg(
        F.count("*").alias("n"), F.min("start_ts").alias("first"), F.max("end_ts").alias("last")
    ).first()
    if bounds["first"] is not None and bounds["last"] is not None:
        first, last = bounds["first"], bounds["last"]
        tagged = tagged.where(F.col("timestamp").between(first, last))
        if "day" in tagged.columns:  # stored by day: choose the folders too
            days = F.col("day").between(first // SECONDS_PER_DAY, last // SECONDS_PER_DAY)
            tagged = tagged.where(days).drop("day")
    inside = F.col("timestamp").between(F.col("start_ts"), F.col("end_ts"))
    if rows_fit_broadcast(bounds["n"], windows.schema):
        return tagged.join(F.broadcast(windows), "candidate").where(inside)
    if existence:
        tagged = tagged.select("candidate", "timestamp").distinct()
    hour = F.floor(F.col("timestamp") / BUCKET_SECONDS)
    first = F.floor(F.col("start_ts") / BUCKET_SECONDS)
    last = F.floor(F.col("end_ts") / BUCKET_SECONDS)
    unfolded = windows.where(F.col("start_ts") <= F.col("end_ts")).withColumn(
        "_hour", F.explode(F.sequence(first, last))
    )
    return (
        tagged.withColumn("_hour", hour)
        .join(unfolded, ["candidate", "_hour"])
        .where(inside)
        .drop("_hour")
    )


def tag_hits(registry: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates that have at least one document in the window.

    Only tag and time are read; hits collapse on the map side.
    """
    probes = tag_candidates(usable_runs(registry)).select(
        *ENTRY, "start_ts", "end_ts", "position", "candidate"
    )
    found = documents_in_windows(
        documents.select("labels", "timestamp", *stored_day(documents)), probes, existence=True
    )
    return found.select(*ENTRY, "position", "candidate").distinct()


def document_zones(documents: DataFrame) -> DataFrame:
    """(tag, hour, least_ts, greatest_ts): where documents of a tag lie in time."""
    hour = F.floor(F.col("timestamp") / BUCKET_SECONDS).alias("hour")
    return (
        documents.where(F.col("labels.tag").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy(F.col("labels.tag").alias("tag"), hour)
        .agg(F.min("timestamp").alias("least_ts"), F.max("timestamp").alias("greatest_ts"))
    )


def tag_hits_by_zones(registry: DataFrame, zones: DataFrame, documents: DataFrame) -> DataFrame:
    """``tag_hits`` answered from the zones; documents are opened only where those cannot tell.

    Both ends of a zone are times of documents, so an end inside the window settles a
    candidate.  Only a window that lies between the ends of a single zone stays open.
    The zones (a row per tag and hour) meet the windows by tag and hour.
    """
    probes = tag_candidates(usable_runs(registry)).select(
        *ENTRY, "start_ts", "end_ts", "position", "candidate"
    )
    first, last = (F.floor(F.col(c) / BUCKET_SECONDS) for c in ("start_ts", "end_ts"))
    unfolded = probes.where("start_ts <= end_ts").withColumn("hour", F.explode(F.sequence(first, last)))
    inside = [F.col(end).between(F.col("start_ts"), F.col("end_ts")) for end in ("least_ts", "greatest_ts")]
    around = (F.col("least_ts") < F.col("start_ts")) & (F.col("greatest_ts") > F.col("end_ts"))
    met = unfolded.join(zones.withColumnRenamed("tag", "candidate"), ["candidate", "hour"])
    settled = checkpointed(
        met.groupBy(*ENTRY, "start_ts", "end_ts", "position", "candidate")
        .agg(F.max(inside[0] | inside[1]).alias("found"), F.max(around).alias("open"))
        .where("found or open")
    )
    keys = [*ENTRY, "position", "candidate"]
    hits = settled.where("found").select(*keys)
    unsure = settled.where("not found").drop("found", "open")
    if not unsure.limit(1).count():
        return hits
    looked_up = documents_in_windows(
        documents.select("labels", "timestamp", *stored_day(documents)), unsure, existence=True
    )
    return hits.unionByName(looked_up.select(*keys).distinct())


def tag_resolve(registry: DataFrame, documents: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """First candidate of every run that exists; runs without one are absent.

    With the ``zones`` of the documents these are hardly opened.
    """
    hits = tag_hits(registry, documents) if zones is None else tag_hits_by_zones(registry, zones, documents)
    return (
        hits.groupBy(*ENTRY)
        .agg(F.min_by("candidate", "position").alias("resolved_tag"))
    )


def relative_time(rows: DataFrame) -> DataFrame:
    """Seconds since the start of the run replace the absolute time."""
    return rows.withColumn("relative_time", F.col("timestamp") - F.col("start_ts")).drop(
        "timestamp", "start_ts"
    )


def extract_resolved(
    registry: DataFrame, resolved: DataFrame, documents: DataFrame
) -> DataFrame:
    """Telemetry of the runs whose tag is resolved (a row per run, passed stored)."""
    windows = usable_runs(registry).join(resolved, ENTRY).select(
        "kd", "test_type", F.col("run_num").alias("run"),
        F.col("resolved_tag").alias("candidate"), "start_ts", "end_ts",
    )
    rows = documents_in_windows(
        documents.select("labels", *fixed.DOCUMENT_FIELDS, *stored_day(documents)), windows
    ).withColumnsRenamed({"id": "metric_id", "name": "metric_name"})
    return relative_time(rows).select(
        "kd", "test_type", "run", "relative_time", "hostname", "chart_context", "chart_id",
        "chart_family", "metric_id", "metric_name", "value", "units",
    )


def extract_run(registry: DataFrame, documents: DataFrame) -> DataFrame:
    """Telemetry of all runs: documents of the resolved tag inside the window.

    The first pass over the documents reads two columns to resolve the tags;
    its result (a row per run) is checkpointed so the second pass, which reads
    the nine wanted fields, does not repeat it.
    """
    resolved = checkpointed(tag_resolve(registry, documents))
    return extract_resolved(registry, resolved, documents)


def ingest_profile(telemetry: DataFrame) -> DataFrame:
    """Per run: rows, contexts, metrics, hosts and length.

    Rows are folded to distinct (host, context, metric) combinations first;
    the distinct counts then run over that catalogue, not over the rows.
    """
    run = ["kd", "test_type", "run"]
    catalogue = telemetry.groupBy(*run, "hostname", "chart_context", "metric_id").agg(
        F.count("*").alias("_rows"), F.max("relative_time").alias("_last")
    )
    return catalogue.groupBy(*run).agg(
        F.sum("_rows").alias("n_rows"),
        F.count_distinct("chart_context").alias("n_contexts"),
        F.count_distinct("chart_context", "metric_id").alias("n_metrics"),
        F.count_distinct("hostname").alias("n_hosts"),
        F.max("_last").alias("max_time_s"),
    )


def run_sizes(telemetry: DataFrame) -> DataFrame:
    """Per run: files and their size in kB; ``telemetry`` is read from run folders."""
    run = ["kd", "test_type", "run"]
    files = telemetry.select(*run, "_metadata.file_path", "_metadata.file_size")
    each = files.groupBy(*run, "file_path").agg(F.max("file_size").alias("_size"))
    return each.groupBy(*run).agg(
        F.count("*").alias("n_files"), F.round(F.sum("_size") / 1024, 1).alias("file_kb")
    )


def manifest(
    requested: DataFrame,
    registry: DataFrame,
    resolved: DataFrame,
    profile: DataFrame,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Status and counts of every requested run.

    All sides have one row per run.
    """
    run = ["kd", "test_type", "run"]
    known = usable_runs(registry).select(
        "kd", "test_type", F.col("run_num").alias("run"), "duration_s",
        F.lit(True).alias("_known"),
    )
    tagged = resolved.select(
        "kd", "test_type", F.col("run_num").alias("run"), F.lit(True).alias("_tagged")
    )
    rows = requested.join(known, run, "left").join(tagged, run, "left").join(profile, run, "left")
    present = F.lit(False)
    if existing is not None:
        marked = existing.select(*run).distinct().withColumn("_existing", F.lit(True))
        rows = rows.join(marked, run, "left")
        present = F.coalesce("_existing", F.lit(False))
    status = (
        F.when(present, "skipped")
        .when(F.col("_known").isNull(), "not_found")
        .when(F.col("_tagged").isNull(), "tag_failed")
        .when(F.coalesce("n_rows", F.lit(0)) == 0, "empty")
        .otherwise("ok")
    )
    done = status == "ok"
    counts = ["n_rows", "n_contexts", "n_metrics", "n_hosts", "duration_s"]
    return rows.select(
        *run, status.alias("status"), *[F.when(done, F.col(name)).alias(name) for name in counts]
    )

"""Writers.

All of them write from the executors; none brings rows to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.labels import fixed_text
from tidegauge.operators.ingest import document_zones
from tidegauge.operators.scans import RUN, run_order, sorted_runs
from tidegauge.schemas import DOCUMENTS, SILVER_COLUMNS
from tidegauge.session import broadcast_if_small, checkpointed, new_table_path


def missing_runs(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested runs that have no rows yet.

    The keys that exist (one per run) are checkpointed before anything is
    written, and broadcast if they are few.
    """
    keys = checkpointed(existing.select(*RUN).distinct())
    return requested.join(broadcast_if_small(keys), RUN, "left_anti")


def write_runs(
    telemetry: DataFrame,
    path: str,
    existing: DataFrame | None = None,
    by_context: bool = False,
) -> None:
    """Sorted run folders, replaced run by run; with ``existing`` only new runs.

    Rows are range partitioned by run, time, host, context and metric: the files of a
    large run are disjoint ranges in the order of their names, so together they are
    sorted, and a time bound skips whole files.  Small runs share a task.  The
    partitioner draws a sample first, for which ``telemetry`` is computed once more.

    ``by_context`` serves the ingest job, whose rows are dear to compute twice: a
    rebalance hint groups rows by run and lets adaptive execution split a large run,
    each file sorted by context.  Only the partitions present in the data are overwritten.

    The string keys are made non-nullable (as the writer itself would name an
    absent one): otherwise the writer converts them after our sort, adds a sort
    of its own, and the order inside the files is lost.
    """
    rows = telemetry if existing is None else missing_runs(telemetry, existing)
    absent = F.lit("__HIVE_DEFAULT_PARTITION__")
    for name in ("kd", "test_type"):
        rows = rows.withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), absent))
    placed = run_order(rows.hint("rebalance", *RUN), by_context) if by_context else sorted_runs(rows)
    (
        placed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RUN)
        .parquet(path)
    )


def write_silver(silver: DataFrame, path: str) -> None:
    """Silver table in canonical column order, one folder per kd.

    The whole table is replaced, so folders of systems that are gone go too.
    """
    (
        silver.select(*SILVER_COLUMNS)
        .hint("rebalance", "kd")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("kd")
        .parquet(path)
    )


@contextmanager
def bucketed(rows: DataFrame, name: str, by: list[str], buckets: int | None = None) -> Iterator[DataFrame]:
    """``rows`` written once in buckets of ``by``; gone from the catalogue at the end.

    Joins and aggregations on ``by`` between tables of as many buckets need no shuffle,
    however often they are made.  Each task writes one bucket, sorted.  The number of
    buckets follows ``spark.sql.shuffle.partitions`` unless it is given.  The files lie
    in the shared or the running job's folder.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_table_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    (
        rows.repartition(buckets, *by)
        .write.bucketBy(buckets, *by)
        .sortBy(*by)
        .option("path", path)
        .format("parquet")
        .saveAsTable(table)
    )
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def write_documents(documents: DataFrame, path: str, zones: str | None = None) -> None:
    """Raw documents as Parquet, one folder per day, sorted by tag and time inside.

    With ``zones`` their index (tag, hour, least and greatest second) is written beside
    them, from the two stored columns that it needs.
    """
    day = F.floor(F.col("timestamp") / 86_400).alias("day")
    (
        documents.select("*", day)
        .hint("rebalance", "day")
        .sortWithinPartitions("day", "labels.tag", "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("day")
        .parquet(path)
    )
    if zones is not None:
        stored = documents.sparkSession.read.schema(DOCUMENTS).parquet(path)
        (
            document_zones(stored)
            .repartitionByRange("tag", "hour")
            .sortWithinPartitions("tag", "hour")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .parquet(zones)
        )


def write_result_csv(result: DataFrame, path: str) -> None:
    """Result table with full precision."""
    result.write.mode("overwrite").option("header", True).csv(path)


def fixed_decimals(result: DataFrame, decimals: int = 6) -> DataFrame:
    """Floating-point columns as text with a fixed number of decimals; NULL stays NULL."""
    return result.select(
        *[
            fixed_text(F.col(name), decimals).alias(name)
            if kind in ("double", "float")
            else F.col(name)
            for name, kind in result.dtypes
        ]
    )


def write_result_csv_fixed(result: DataFrame, path: str, decimals: int = 6) -> None:
    """Result table at a fixed number of decimals."""
    write_result_csv(fixed_decimals(result, decimals), path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines: classification, manifest, detailed verdicts."""
    rows.write.mode("overwrite").json(path)


def write_verdicts(verdicts: DataFrame, csv_path: str, json_path: str) -> None:
    """Flat verdict table as CSV, evidence and statistics as JSON."""
    flat = verdicts.select(
        "proposition_id", "direction", "hypothesis", "supported", "strength", "verdict"
    )
    write_result_csv(flat, csv_path)
    write_json(verdicts, json_path)

"""Raw metric documents, run registry and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed
from tidegauge import schemas
from tidegauge.functions.tags import WHITESPACE
from tidegauge.functions.telemetry import clean_number
from tidegauge.sources.files import or_empty, read_json

# plain folders and key=value folders, and files written as folders of parts
RUN_FILE = (
    r"/(?:kd=)?([^/=]+)/(?:test_type=)?([^/=]+)/(?:run_dir=)?([^/=]+)"
    r"/(?:file_name=)?([^/=]+?)(?:/part-[^/]*)?$"
)

# part files belong to a log or marker that was written as a folder of parts
RUN_FILES_READ = f"{{{fixed.LOG_PREFIX}*,{fixed.START_MARKER},{fixed.END_MARKER},part-*}}"
SECONDS_PER_DAY = 86_400


def read_documents(
    spark: SparkSession, path: str, form: str = "parquet", required: bool = False
) -> DataFrame:
    """Documents as Parquet by day (``sinks.write_documents``) or JSON lines.

    Bounds on ``timestamp`` reach the scan; on stored Parquet they also choose the
    day folders.  A broken JSON line is an error.
    """
    schema = schemas.DOCUMENTS
    reader = spark.read.schema(schema).format(form)
    if form == "json":
        reader = reader.option("mode", "FAILFAST")
    rows = or_empty(spark, schema, lambda: reader.load(path), required)
    return rows.withColumn("value", clean_number(F.col("value")))


def read_stored_documents(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Stored documents of a closed time window: only its day folders are listed and read."""
    days = f"{schemas.DOCUMENTS}, day bigint"
    rows = or_empty(spark, days, lambda: spark.read.schema(days).parquet(path))
    inside = F.col("timestamp").between(start, end)
    within = F.col("day").between(start // SECONDS_PER_DAY, end // SECONDS_PER_DAY)
    return rows.where(inside & within).drop("day").withColumn(
        "value", clean_number(F.col("value"))
    )


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Index of stored documents: tag, hour, least and greatest second."""
    schema = "tag string, hour bigint, least_ts bigint, greatest_ts bigint"
    return or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(path))


def documents_of_tag(documents: DataFrame, tag: str, start: int, end: int) -> DataFrame:
    """The nine wanted fields of one tag inside a closed time window."""
    return documents.where(
        (F.col("labels.tag") == tag) & F.col("timestamp").between(start, end)
    ).select(*fixed.DOCUMENT_FIELDS)


def read_registry(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Run registry, one object per line; ``whole`` for a file with one array."""
    return read_json(spark, path, schemas.REGISTRY, whole)


def _in_run_folders(files: DataFrame, *columns: str) -> DataFrame:
    """Key and file name from the path, and only logs and markers."""
    location = F.col("_metadata.file_path")
    return files.select(
        *[
            F.regexp_extract(location, RUN_FILE, place).alias(name)
            for place, name in enumerate(["kd", "test_type", "run_dir", "file_name"], start=1)
        ],
        *[F.expr(column) for column in columns],
    ).where(
        (F.col("run_dir") != "")
        & (
            F.col("file_name").startswith(fixed.LOG_PREFIX)
            | F.col("file_name").isin(fixed.START_MARKER, fixed.END_MARKER)
        )
    )


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Whole text of the logs and markers below ``{kd}/{test}/{run directory}/``.

    Only these three kinds of file are opened, and each is one row; long logs are read
    by ``read_run_log_lines``.
    """
    schema = "kd string, test_type string, run_dir string, file_name string, text string"

    def read() -> DataFrame:
        files = spark.read.text(
            path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=RUN_FILES_READ
        )
        return _in_run_folders(files, "value AS text")

    return or_empty(spark, schema, read)


LOG_LINES = (
    "kd string, test_type string, run_dir string, file_name string, part string, block bigint, "
    "place bigint, line string"
)


def read_run_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the same files, blank ones left out, with their place in the file.

    A long log is cut into several splits.  Lines are ordered by (part, block, place):
    the file, the first byte of the split, and a number that rises by one from line to
    line of a split.
    """

    def read() -> DataFrame:
        files = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=RUN_FILES_READ)
        filled = files.where(F.btrim("value", F.lit(WHITESPACE + "\u0000")) != "")
        return _in_run_folders(
            filled.withColumn("place", F.monotonically_increasing_id()),
            "_metadata.file_path AS part", "_metadata.file_block_start AS block", "place", "value AS line",
        )

    return or_empty(spark, LOG_LINES, read)

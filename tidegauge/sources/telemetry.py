"""Telemetry tables, silver tables and earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.functions.telemetry import clean_number
from tidegauge.sources.files import or_empty, read_json

RUN_FILE = r"([^/]+)/([^/]+)_run(\d+)\.parquet$"


def normalised(telemetry: DataFrame) -> DataFrame:
    """NaN values become NULL; every reader of values passes through here."""
    return telemetry.withColumn("value", clean_number(F.col("value")))


def read_telemetry(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """Telemetry partitioned by kd, test_type and run.

    A predicate on the run key selects folders without opening files.  With
    ``required`` an absent path is an error: pass it for the root of a job, whose
    results an empty table would overwrite.
    """
    schema = schemas.TELEMETRY_PARTITIONED
    rows = or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(path), required)
    return normalised(rows)


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry in one file per run, ``{kd}/{test}_run{n}.parquet``.

    The run key comes from the file path.
    """

    def read() -> DataFrame:
        files = spark.read.schema(schemas.TELEMETRY).parquet(f"{path}/*/*_run*.parquet")
        location = F.col("_metadata.file_path")
        return files.select(
            *files.columns,
            F.regexp_extract(location, RUN_FILE, 1).alias("kd"),
            F.regexp_extract(location, RUN_FILE, 2).alias("test_type"),
            F.regexp_extract(location, RUN_FILE, 3).cast("int").alias("run"),
        )

    return normalised(or_empty(spark, schemas.TELEMETRY_PARTITIONED, read))


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    """Silver table, partitioned by kd."""
    schema = schemas.SILVER
    rows = or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(path))
    return rows.select(*schemas.SILVER_COLUMNS)


def read_result_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table written earlier; empty where it does not exist."""
    return or_empty(
        spark, schema, lambda: spark.read.schema(schema).option("header", True).csv(path)
    )


def read_classification(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Pod classification, one object per line; ``whole`` for a file with one array."""
    return read_json(spark, path, schemas.CLASSIFICATION, whole)


def classification_by_pod(classification: DataFrame) -> DataFrame:
    """One entry per pod: of duplicates the last by (kd, host) wins."""
    order = F.struct("kd", "hostname")
    entry = F.struct(*classification.columns)
    return (
        classification.groupBy("pod_uuid")
        .agg(F.max_by(entry, order).alias("_entry"))
        .select("_entry.*")
    )

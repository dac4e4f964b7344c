"""Benchmark CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.session import broadcast_if_small
from tidegauge.sources.files import or_empty

SERIES = r"([A-Za-z0-9]+-idle-[^/]*?)-(cpu|ram)(?:\.csv)?(?:/[^/]*)?$"
ATTRIBUTABLE = ["k3s", "k0s"]


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return or_empty(
        spark, schema, lambda: spark.read.schema(schema).option("header", True).csv(path)
    )


def read_pod_startup(spark: SparkSession, path: str) -> DataFrame:
    """Pod start-up latency."""
    return _csv(spark, path, schemas.POD_STARTUP_CSV).withColumnsRenamed(schemas.CSV_RENAMES)


def read_api_latency(spark: SparkSession, path: str) -> DataFrame:
    """API latency; all test files in one read, the ``tests`` column tells them apart."""
    return _csv(spark, path, schemas.API_LATENCY_CSV).withColumnsRenamed(schemas.CSV_RENAMES)


def _series_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all series files as text, with a column for what a row has too many."""
    schema = "hostname string, value string, timestamp string, _extra string"

    def read() -> DataFrame:
        files = (
            spark.read.schema(schema)
            .option("header", True)
            .option("recursiveFileLookup", True)
            .csv(path)
        )
        return files.select("*", F.col("_metadata.file_path").alias("file"))

    return or_empty(spark, f"{schema}, file string", read)


def refused_series_files(spark: SparkSession, path: str) -> DataFrame:
    """Series files that are left out as a whole: some row has too many fields."""
    return _series_cells(spark, path).where(F.col("_extra").isNotNull()).select("file").distinct()


def read_idle_series(spark: SparkSession, path: str, metric: str = "cpu") -> DataFrame:
    """Idle series of the systems that the file names attribute.

    System and run come from the name (``k0s-idle-3,k0s-idle-4,-cpu.csv``), as
    a file or as a folder of part files.  A cell that is no number becomes NULL
    and its row stays.  A file with a row of too many fields is left out whole
    (``refused_series_files`` lists them); a file that cannot be read is an error.
    """
    location = F.col("file")
    name = F.regexp_extract(location, SERIES, 1)
    refused = broadcast_if_small(refused_series_files(spark, path))
    rows = _series_cells(spark, path).join(refused, "file", "left_anti").select(
        "hostname",
        F.col("value").try_cast("double").alias("value"),
        F.col("timestamp").try_cast("bigint").alias("timestamp"),
        name.alias("run"),
        F.regexp_extract(name, r"^(\w+)-idle-", 1).alias("kd"),
        F.regexp_extract(location, SERIES, 2).alias("_metric"),
    )
    return rows.where(
        F.col("kd").isin(ATTRIBUTABLE) & (F.col("_metric") == metric)
    ).drop("_metric")

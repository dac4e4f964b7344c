"""A silver layer that grows run by run.

Per run, host, container and metric a state keeps the sums over seconds of the
per-second sum and maximum, and the number of seconds.  States of different seconds
add up, and a run's states are replaced as a whole.  A version per run (files, bytes,
latest change) says which runs are new or replaced; only these are scanned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import telemetry as cells
from tidegauge.operators.scans import RUN
from tidegauge.operators.silver import container_seconds
from tidegauge.schemas import RUN_KEY, SILVER_COLUMNS
from tidegauge.session import broadcast_if_small, checkpointed
from tidegauge.sources.files import or_empty
from tidegauge.sources.telemetry import read_telemetry

STATE_KEY = [*RUN, "hostname", "container", "metric"]
STATES = (
    "hostname string, container string, metric string, sum_of_sums double, "
    f"sum_of_maxima double, n_seconds bigint, n_maxima bigint, version string, {RUN_KEY}"
)
VERSIONS = f"{RUN_KEY}, version string"


def run_versions(spark: SparkSession, path: str) -> DataFrame:
    """(kd, test_type, run, version) of stored run folders, from the file listing alone.

    The listing is a table whose contents column is not read; no footer is opened.
    """

    def read() -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        version = F.concat_ws(
            ":", F.count("*"), F.sum("length"), F.unix_micros(F.max("modificationTime"))
        )
        keys = [F.col(name).cast(kind).alias(name) for name, kind in zip(RUN, ("string", "string", "int"))]
        return files.select(*keys, "length", "modificationTime").groupBy(*RUN).agg(version.alias("version"))

    return or_empty(spark, VERSIONS, read)


def container_states(telemetry: DataFrame, definitions: DataFrame) -> DataFrame:
    """States of all runs in ``telemetry``; rows of no container fall out."""
    return (
        container_seconds(telemetry, definitions)
        .groupBy(*RUN, "hostname", F.col("_container").alias("container"), "metric")
        .agg(
            F.sum("_sum").alias("sum_of_sums"),
            F.sum("_max").alias("sum_of_maxima"),
            F.count("*").alias("n_seconds"),
            F.max(F.col("_container") != "").alias("_matched"),
            F.count("_max").alias("n_maxima"),
        )
        .where("_matched")
        .drop("_matched")
    )


def silver_of(states: DataFrame, definitions: DataFrame) -> DataFrame:
    """Silver rows of states; several states of one key (of different seconds) add up."""
    merged = states.groupBy(*STATE_KEY).agg(
        F.sum("sum_of_sums").alias("_sums"),
        F.sum("sum_of_maxima").alias("_maxima"),
        F.sum("n_seconds").alias("n_samples"),
        F.sum("n_maxima").alias("_n_maxima"),
    )
    rules = definitions.select("metric", F.col("metric_units").alias("units"), "dim_agg")
    value = F.when(F.col("dim_agg") == "sum", F.try_divide("_sums", "n_samples")).otherwise(
        F.try_divide("_maxima", "_n_maxima")
    )
    container = F.col("container")
    # the definitions are nine fixed rows
    return merged.join(F.broadcast(rules), "metric").select(
        *RUN, "hostname", cells.pod_uuid(container).alias("pod_uuid"),
        cells.qos_class(container).alias("qos_class"), "metric", value.alias("value"), "units", "n_samples",
    ).select(*SILVER_COLUMNS)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """States of the runs as last grown; leftovers of replaced or removed runs do not count."""
    states = or_empty(spark, STATES, lambda: spark.read.schema(STATES).parquet(f"{path}/states"))
    return states.join(read_versions(spark, path), [*RUN, "version"], "left_semi")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Versions of the runs that the states hold."""
    return or_empty(spark, VERSIONS, lambda: spark.read.schema(VERSIONS).parquet(f"{path}/versions"))


def grow_silver(spark: SparkSession, runs: str, path: str, definitions: DataFrame) -> DataFrame:
    """Bring the states at ``path`` up to the run folders at ``runs``; returns the runs scanned.

    Runs whose version is known are not opened: the changed ones prune the scan's
    folders.  States are written before versions, so a job that breaks off leaves its
    runs to be done again, and doing them again replaces them.
    """
    listed = checkpointed(run_versions(spark, runs))
    known = checkpointed(read_versions(spark, path))
    # the comparison lets Spark prune folders by the few runs of the small side
    changed = checkpointed(listed.join(known, [*RUN, "version"], "left_anti")).where("version > ''")
    rows = read_telemetry(spark, runs).join(broadcast_if_small(changed), RUN)
    states = container_states(rows.drop("version"), definitions).join(broadcast_if_small(changed), RUN)
    (
        states.hint("rebalance", *RUN)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RUN)
        .parquet(f"{path}/states")
    )
    listed.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/versions")
    return changed

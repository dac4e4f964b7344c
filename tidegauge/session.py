"""Session settings, the shared folder, and the checks made before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Size above which a table that grows with the data is no longer broadcast.
BROADCAST_BYTES = 32 << 20
# Declared width of a value of no fixed size, such as a string.
VALUE_BYTES = 64

# Folder of the job that is running, if one is.
_job_folder: ContextVar[str | None] = ContextVar("job_folder", default=None)


def build_session(app: str = "tidegauge", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for.

    On a cluster shuffles start with many partitions; adaptive execution merges
    small ones up to the advisory size and splits skewed ones, so the number
    follows the data.  A local session takes its number from ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.session.timeZone": "UTC",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    if not (master or "").startswith("local"):
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = "8192"
        settings["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = "false"
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fixed_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small constant table as a local relation.

    Going through Arrow keeps the rows in the plan, where the optimizer can
    filter and fold them; a list would become an RDD read by Python workers.
    """
    fields = T.StructType.fromDDL(schema).names
    columns = {name: [row[i] for row in rows] for i, name in enumerate(fields)}
    table = pa.table(
        [pa.array(values) for values in columns.values()], names=list(columns)
    )
    casts = T.StructType.fromDDL(schema).fields
    return spark.createDataFrame(table).select(
        *[F.col(field.name).cast(field.dataType) for field in casts]
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees, as the cluster names it.

    Only a local session without the setting gets a folder of its own; there
    driver and executors are one process.  A ``file:`` folder named by the cluster
    is taken at its word: it has to be a mount that all machines share.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidegauge-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, or in the running job's, that nothing else uses."""
    folder = _job_folder.get() or shared_folder(spark)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def job_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for the tables that a job writes on its way; it goes when the job ends.

    Registered queries return lazy results that still read such tables, so they
    stay in the shared folder until the cluster cleans it.
    """
    path = new_table_path(spark, name)
    token = _job_folder.set(path)
    try:
        yield path
    finally:
        _job_folder.reset(token)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several branches need the same reduced table: the big scan then
    runs once, the plan is cut, and a lost executor costs no recomputation.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def declared_width(schema: T.StructType) -> int:
    """Bytes of a row by its declared types."""
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    wide = ("bigint", "double", "timestamp", "timestamp_ntz")
    return 16 + sum(
        fixed.get(kind, 8 if kind in wide else VALUE_BYTES)
        for kind in (field.dataType.simpleString() for field in schema.fields)
    )


def rows_fit_broadcast(rows: int, schema: T.StructType) -> bool:
    """Whether that many rows are small by their declared width."""
    return rows * declared_width(schema) <= BROADCAST_BYTES


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether ``df`` is small: its rows times their declared width, or a row limit."""
    if max_rows is None:
        max_rows = BROADCAST_BYTES // declared_width(df.schema)
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast hint behind a size check; beyond it the join shuffles."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df

"""Shared helpers of the readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def or_empty(
    spark: SparkSession, schema: str, read: Callable[[], DataFrame], required: bool = False
) -> DataFrame:
    """The table, or an empty one of the same schema where the path is absent.

    With ``required`` an absent path is an error; jobs ask for that on their roots.
    """
    try:
        return read()
    except AnalysisException as error:
        if required or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """One object per line, or with ``whole`` one array or object per file.

    A broken object is an error: it would become a row of NULLs and be lost unseen.
    """
    reader = spark.read.schema(schema).option("multiLine", whole).option("mode", "FAILFAST")
    return or_empty(spark, schema, lambda: reader.json(path))

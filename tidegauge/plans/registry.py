"""Collects the registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.plans.inputs import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Round the named columns, so that the order of a sum does not show."""
    return df.select(
        *[
            F.round(name, columns[name]).alias(name) if name in columns else F.col(name)
            for name in df.columns
        ]
    )


def query(
    name: str,
    *,
    ctes: str = "",
    sql: str | None = None,
    digits: int = 6,
    rounds: str = "",
    **special: int,
):
    """Register ``fn(inputs)`` under ``name``.

    ``rounds`` lists floating-point columns to round to ``digits`` on both
    sides; ``special`` gives other precisions for single columns.  More digits
    than six serve small values whose means end in a 5 at the seventh digit.
    """
    columns = {column: digits for column in rounds.split()} | special

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Inputs(spark, sf_dir)), columns)

        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if columns:
                fixes = ", ".join(f"round({c}, {d}) AS {c}" for c, d in columns.items())
                head, _, last = body.rpartition("--result")
                prefix = f"{head.rstrip()}\n" if head else ""
                body = f"{prefix}SELECT * REPLACE ({fixes}) FROM (\n{last.strip()}\n)"
            ORACLES[name] = f"{ctes}{body}" if ctes else body
        return fn

    return register

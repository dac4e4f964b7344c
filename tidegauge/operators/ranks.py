"""Ranks and medians without putting a whole group into one task.

A rank needs a running count over all rows of a group.  Rows are first folded
into a histogram (one row per distinct value, combined on the map side), so a
value shared by a third of the rows is one row.  The histogram is placed in
ordered slices by Spark's range partitioner and checkpointed, which fixes the
slice of every row.  Running counts inside slices plus slice offsets then give
global ranks; no step holds more than one slice of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import checkpointed


def value_histogram(rows: DataFrame, by: list[str], value: str, *also: str) -> DataFrame:
    """Count of rows per key, value and any further columns; NULLs are left out."""
    kept = rows.where(F.col(value).isNotNull())
    for name in by:
        kept = kept.where(F.col(name).isNotNull())
    return kept.groupBy(*by, value, *also).agg(F.count("*").alias("n"))


def with_running_counts(histogram: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add ``n_below`` (smaller values), ``n_tied`` (this value), ``n_total``.

    Rows of one value always share a slice.  Counts are exact integers.
    """
    placed = checkpointed(
        histogram.repartitionByRange(*by, value).withColumn("_slice", F.spark_partition_id())
    )
    totals = placed.groupBy(*by, "_slice").agg(F.sum("n").alias("_in_slice"))
    earlier = (
        Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *by,
        "_slice",
        F.coalesce(F.sum("_in_slice").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_in_slice").over(Window.partitionBy(*by)).alias("n_total"),
    )
    ordered = Window.partitionBy(*by, "_slice").orderBy(value)
    up_to = F.sum("n").over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tied = F.sum("n").over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return (
        placed.withColumn("_up_to", up_to)
        .withColumn("n_tied", tied)
        .join(offsets, [*by, "_slice"])
        .withColumn("n_below", F.col("_offset") + F.col("_up_to") - F.col("n_tied"))
        .drop("_slice", "_up_to", "_offset")
    )


def mid_rank():
    """Mean rank of tied rows."""
    return F.col("n_below") + (F.col("n_tied") + 1) / 2


def rank_average_ties(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mid-rank of every distinct value, with the number of rows that share it."""
    counted = with_running_counts(value_histogram(rows, by, value), by, value)
    return counted.select(*by, value, "n_tied", "n_total", mid_rank().alias("mid_rank"))


def median_places() -> dict[str, Column]:
    """Whether a counted value holds the lower, and the upper, of the one or two middle places."""
    low = F.floor((F.col("n_total") + 1) / 2)
    high = F.floor((F.col("n_total") + 2) / 2)
    upper_place = F.col("n_below") + F.col("n_tied")
    return {
        name: (F.col("n_below") < place) & (upper_place >= place)
        for name, place in (("_low", low), ("_high", high))
    }


def exact_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact median per key: the values that hold the one or two middle places."""
    counted = with_running_counts(value_histogram(rows, by, value), by, value)
    places = median_places()
    ends = [F.max(F.when(holds, F.col(value))) for holds in places.values()]
    return (
        counted.where(places["_low"] | places["_high"])
        .groupBy(*by)
        .agg(((ends[0] + ends[1]) / 2).alias("median"))
    )

"""Rank statistics and trend lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import probability as tails
from tidegauge.functions.labels import stars
from tidegauge.operators.ranks import median_places, mid_rank, value_histogram, with_running_counts
from tidegauge.session import written

EXACT_UP_TO = 8


def with_spearman_p(rows: DataFrame) -> DataFrame:
    """Two-sided p from the t distribution; a perfect correlation has p 0.

    The statistic becomes a column first, so the tail expression stays small.
    """
    rho, n = F.col("spearman_rho"), F.col("n_points")
    freedom = F.when(n >= 3, n - 2)
    t = F.abs(rho) * F.sqrt(F.try_divide(freedom.cast("double"), (1 - rho) * (1 + rho)))
    p = F.when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(
        tails.student_two_sided(F.col("_t"), F.col("_freedom"))
    )
    return rows.select("*", t.alias("_t"), freedom.alias("_freedom")).withColumn("p_value", p)


def _correlation(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Correlation of centred ranks ``dx``, ``dy`` weighted by ``n``."""
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("n_points"),
        F.sum(F.col("n") * F.col("dx") * F.col("dy")).alias("_xy"),
        F.sum(F.col("n") * F.col("dx") * F.col("dx")).alias("_xx"),
        F.sum(F.col("n") * F.col("dy") * F.col("dy")).alias("_yy"),
    )
    raw = F.try_divide("_xy", F.sqrt("_xx") * F.sqrt("_yy"))
    rho = F.when(F.col("n_points") >= 3, F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0)))
    rated = sums.select(*by, "n_points", F.when(raw.isNotNull(), rho).alias("spearman_rho"))
    return with_spearman_p(rated).select(
        *by, "spearman_rho", "p_value", F.col("n_points").alias("n")
    )


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman correlation per key at any size.

    Pairs are folded into distinct (x, y) first and written once, so the rows
    are scanned a single time.  Ranks of x and of y are
    looked up by equi-joins whose right side has unique keys; a value shared
    by many pairs is split by adaptive skew handling.  Fewer than three points
    or a constant column give NULL.
    """
    folded = (
        rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.count("*").alias("n"))
    )
    pairs = written(folded, "pairs")
    ranked = pairs
    for column, centred in (("_x", "dx"), ("_y", "dy")):
        sides = pairs.groupBy(*by, column).agg(F.sum("n").alias("n"))
        counted = with_running_counts(sides, by, column)
        ranks = counted.select(
            *by, column, (mid_rank() - (F.col("n_total") + 1) / 2).alias(centred)
        )
        ranked = ranked.join(ranks, [*by, column])
    return _correlation(ranked, by)


def spearman_of_systems(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman correlation over one point per system.

    The groups hold at most one row per system (five), so plain windows do;
    all of them share one partitioning.
    """
    kept = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    whole = Window.partitionBy(*by)

    def centred(column: str) -> Column:
        order = whole.orderBy(column)
        ties = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
        rank = F.rank().over(order) + (ties - 1) / 2
        return rank - (F.count("*").over(whole) + 1) / 2

    ranked = kept.select(
        *by, F.lit(1).alias("n"), centred(x).alias("dx"), centred(y).alias("dy")
    )
    return _correlation(ranked, by)


def rank_pass(rows: DataFrame, by: list[str], value: str, is_first: Column) -> DataFrame:
    """Rank tests and medians of many comparisons by one ranking.

    Rows of all comparisons form one histogram per key, which is ranked once; every
    figure is a conditional sum over it.  Per key: n, n1, n2, u_statistic, p_value (the
    first sample is smaller) and median.  Where ``is_first`` is NULL a row counts for n
    and the median only.  Rows with a NULL key or value are left out.
    """
    kept = rows.withColumn("_first", is_first.cast("int")).where(F.col(value).isNotNull())
    for name in by:
        kept = kept.where(F.col(name).isNotNull())
    histogram = kept.groupBy(*by, value).agg(
        F.count("*").alias("n"), F.sum("_first").alias("_n1"), F.sum(1 - F.col("_first")).alias("_n2")
    )
    counted = with_running_counts(histogram, by, value)
    ties = F.col("n_tied").cast("double")
    places = median_places()
    sums = counted.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("_n1").alias("n1"),
        F.sum("_n2").alias("n2"),
        F.sum(F.col("_n1") * mid_rank()).alias("_rank_sum"),
        F.sum(ties * ties * ties - ties).alias("_ties"),
        *[F.max(F.when(holds, F.col(value))).alias(name) for name, holds in places.items()],
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    u1 = F.col("_rank_sum") - n1 * (n1 + 1) / 2
    u2 = n1 * n2 - u1
    variance = n1 * n2 / 12 * (total + 1 - F.try_divide("_ties", total * (total - 1)))
    both = (n1 > 0) & (n2 > 0)
    small = both & (F.least("n1", "n2") <= EXACT_UP_TO) & (F.col("_ties") == 0)
    exact = tails.exact_rank_sum_lower("_m", "_n", "_u", EXACT_UP_TO)
    asymptotic = F.when(both, tails.normal_upper(F.col("_z")))
    return (
        sums.withColumns(
            {
                "_z": F.try_divide(u2 - n1 * n2 / 2 - 0.5, F.sqrt(variance)),
                "u_statistic": F.when(both, u1),
                "_small": small,
                "_m": F.least("n1", "n2").cast("bigint"),
                "_n": F.greatest("n1", "n2").cast("bigint"),
                "_u": F.floor(u1).cast("bigint"),
                "median": (F.col("_low") + F.col("_high")) / 2,
            }
        )
        .withColumn("p_value", F.when(F.col("_small"), exact).otherwise(asymptotic))
        .select(*by, "n", "n1", "n2", "u_statistic", "p_value", "median")
    )


def mann_whitney_less(rows: DataFrame, by: list[str], value: str, is_first: Column) -> DataFrame:
    """U of the first sample and the one-sided p that it is smaller.

    With a sample of at most eight values and no ties p is exact; otherwise it is
    asymptotic with tie and continuity correction.  An empty sample gives NULL; rows
    with a NULL key or flag are left out.
    """
    flagged = rows.withColumn("_flag", is_first).where(F.col("_flag").isNotNull())
    return rank_pass(flagged, by, value, F.col("_flag")).select(*by, "n1", "n2", "u_statistic", "p_value")


def kruskal_wallis(
    rows: DataFrame, by: list[str], group: str, value: str, digits: int = 9
) -> DataFrame:
    """H (tie corrected), p and stars of the groups within every key.

    Values are rounded to ``digits`` decimals before they are ranked: means of the
    same readings can differ in their last bits, and such values are ties.
    """
    levels = rows.where(F.col(group).isNotNull()).withColumn(value, F.round(value, digits))
    histogram = value_histogram(levels, by, value, group)
    counted = with_running_counts(histogram, by, value)
    ties = F.col("n_tied").cast("double")
    # each value contributes t**3 - t once; spread it over the rows that share it
    per_group = counted.groupBy(*by, group, "n_total").agg(
        F.sum("n").alias("_n"),
        F.sum(F.col("n") * (mid_rank() - (F.col("n_total") + 1) / 2)).alias("_rank_sum"),
        F.sum(F.col("n") * (ties * ties - 1)).alias("_ties"),
    )
    total = F.col("n_total").cast("double")
    raw = F.sum(F.col("_rank_sum") * F.col("_rank_sum") / F.col("_n"))
    tie_factor = 1 - F.try_divide(F.sum("_ties"), total * total * total - total)
    return (
        per_group.groupBy(*by, "n_total")
        .agg(
            F.try_divide(12 * raw, total * (total + 1) * tie_factor).alias("kruskal_h"),
            F.count("*").alias("n_groups"),
        )
        .withColumn(
            "kruskal_p",
            F.when(
                F.col("n_groups") >= 2,
                tails.chi_square_upper(F.col("kruskal_h"), F.col("n_groups") - 1),
            ),
        )
        .withColumn(
            "significance", F.when(F.col("kruskal_p").isNotNull(), stars(F.col("kruskal_p")))
        )
        .select(*by, "kruskal_h", "kruskal_p", "n_groups", F.col("n_total").alias("n"),
                "significance")
    )


def irq_cross_kd(run_rates: DataFrame) -> DataFrame:
    """Kruskal-Wallis over systems per test beside each system's mean and deviation.

    Two branches read ``run_rates`` (a row per run); pass it written.
    """
    levels = run_rates.groupBy("test_type", "kd").agg(
        F.avg("irq_rate").alias("irq_rate_mean"), F.stddev_pop("irq_rate").alias("irq_rate_std")
    )
    tests = kruskal_wallis(run_rates, ["test_type"], "kd", "irq_rate")
    return levels.join(
        tests.select("test_type", "kruskal_h", "kruskal_p", "significance"), "test_type"
    )


def linear_trend(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line per key; a constant x gives NULL."""
    return points.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )

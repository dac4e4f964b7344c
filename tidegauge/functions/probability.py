"""Tail probabilities as column expressions.

Spark has no error function and no t or chi-square distribution.  All degrees
of freedom met here are integers, so each tail is a finite sum, a short series
or a continued fraction, folded over a constant or short sequence.
"""

from __future__ import annotations

import json
import math
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_TERMS = 60
FRACTION_DEPTH = 120
SERIES_BELOW = 2.5
EXACT_T_BELOW = 1000


def normal_density(z: Column) -> Column:
    """Standard normal density."""
    return F.exp(-z * z / 2.0) / F.lit(math.sqrt(2.0 * math.pi))


def normal_upper(z: Column) -> Column:
    """P(Z > z): power series near zero, continued fraction in the tails."""
    size = F.abs(z)
    terms = F.sequence(F.lit(1), F.lit(SERIES_TERMS))
    series = F.aggregate(
        terms,
        F.struct(size.alias("term"), size.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * size * size / (2 * k + 1)).alias("term"),
            (acc["total"] + acc["term"] * size * size / (2 * k + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    depth = F.sequence(F.lit(FRACTION_DEPTH), F.lit(1), F.lit(-1))
    far = F.greatest(size, F.lit(1.0))
    fraction = F.aggregate(depth, far, lambda acc, k: far + k / acc)
    upper = F.when(size < SERIES_BELOW, F.lit(0.5) - normal_density(size) * series).otherwise(
        normal_density(size) / fraction
    )
    return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for integer ``df``; NULL t gives NULL, infinite t gives 0.

    Up to a thousand degrees of freedom the finite trigonometric sum is used.
    Beyond, the expansion around the normal in powers of 1/df is exact to
    about twelve digits, and no sequence grows with the data.
    """
    size = F.abs(t)
    angle = F.atan(size / F.sqrt(df))
    sine, cosine = F.sin(angle), F.cos(angle)
    odd = df % 2 == 1
    start = F.when(odd, cosine).otherwise(F.lit(1.0))
    count = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    steps = F.when(
        (count >= 1) & (df <= EXACT_T_BELOW), F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    ).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))

    def grow(acc: Column, k: Column) -> Column:
        ratio = F.when(odd, 2.0 * k / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
        term = acc["term"] * cosine * cosine * ratio
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(
        steps, F.struct(start.alias("term"), start.alias("total")), grow, lambda acc: acc["total"]
    )
    inside = (
        F.when(df == 1, angle * F.lit(2.0 / math.pi))
        .when(odd, (angle + sine * total) * F.lit(2.0 / math.pi))
        .otherwise(sine * total)
    )
    t2 = size * size
    first = size * (t2 + 1.0) / 4.0
    second = size * (((3.0 * t2 - 7.0) * t2 - 5.0) * t2 - 3.0) / 96.0
    third = size * (((((t2 - 11.0) * t2 + 14.0) * t2 + 6.0) * t2 - 3.0) * t2 - 15.0) / 384.0
    wide = 2.0 * (
        normal_upper(size)
        + normal_density(size) * (first / df + second / (df * df) + third / (df * df * df))
    )
    # beyond 38 standard deviations the normal tail is below the smallest double
    tail = F.when(df <= EXACT_T_BELOW, F.lit(1.0) - inside).when(size > 38.0, 0.0).otherwise(wide)
    # greatest() skips NULL, so an undefined statistic is kept apart
    return F.when(size == F.lit(float("inf")), F.lit(0.0)).when(
        size.isNotNull(), F.greatest(tail, F.lit(0.0))
    )


def chi_square_upper(x: Column, df: Column) -> Column:
    """P(X > x) for integer ``df`` (one less than the number of groups)."""
    half = x / 2.0
    even = df % 2 == 0
    root = F.sqrt(x)
    first = F.when(even, F.exp(-half)).otherwise(2.0 * normal_density(root) * root)
    base = F.when(even, F.lit(0.0)).otherwise(2.0 * normal_upper(root))
    count = F.when(even, df / 2).otherwise((df - 1) / 2).cast("int")
    steps = F.when(count >= 2, F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1)))).otherwise(
        F.expr("CAST(array() AS ARRAY<INT>)")
    )
    start = F.when(count >= 1, first).otherwise(F.lit(0.0))

    def grow(acc: Column, k: Column) -> Column:
        step = F.when(even, half / k).otherwise(x / (2.0 * k + 1.0))
        term = acc["term"] * step
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(
        steps, F.struct(start.alias("term"), start.alias("total")), grow, lambda acc: acc["total"]
    )
    return F.when(x <= 0, F.lit(1.0)).otherwise(base + total)


def _order_terms(m: int) -> list[tuple[int, int, float]]:
    """(k, s, c): the product of (1 - q^(n+i)) for i = 1..m is the sum of c q^(kn+s)."""
    terms = {(0, 0): 1}
    for i in range(1, m + 1):
        step = dict(terms)
        for (k, s), c in terms.items():
            step[k + 1, s + i] = step.get((k + 1, s + i), 0) - c
        terms = step
    return [(k, s, float(c)) for (k, s), c in sorted(terms.items()) if c]


def _period_weights(m: int) -> tuple[int, list[int]]:
    """L and the polynomial (1 - q^L)^(m+1) / ((1 - q) (1 - q) (1 - q^2) .. (1 - q^m)).

    L is the least common multiple of 1..m.  Each factor (1 - q^L) / (1 - q^i) is a sum
    of every i-th power, so it multiplies by running sums of every i-th coefficient.
    """
    period = math.lcm(*range(1, m + 1))
    weights = [1] + [0] * ((m + 1) * period - 1)
    for i in (1, *range(1, m + 1)):
        for at in range(i, len(weights)):
            weights[at] += weights[at - i]
        for at in range(len(weights) - 1, period - 1, -1):
            weights[at] -= weights[at - period]
    return period, weights


@cache
def _rank_sum_tables(up_to: int) -> str:
    """A constant: period, weights and order terms of every size, as SQL that is folded once."""
    tables = []
    for size in range(1, up_to + 1):
        period, weights = _period_weights(size)
        terms = [{"k": k, "s": s, "c": c} for k, s, c in _order_terms(size)]
        tables.append({"period": period, "weights": weights, "terms": terms})
    kind = "period: BIGINT, weights: ARRAY<DOUBLE>, terms: ARRAY<STRUCT<k: BIGINT, s: BIGINT, c: DOUBLE>>"
    return f"from_json('{json.dumps(tables)}', 'ARRAY<STRUCT<{kind}>>')"


def exact_rank_sum_lower(smaller: str, larger: str, u: str, up_to: int) -> Column:
    """P(U <= u) of the rank-sum statistic without ties; arguments name bigint columns.

    ``smaller`` lies in 1..``up_to``; the other sample has any size.  The number of
    orders with U <= u is the coefficient of q^u in the product of (1 - q^(n+i)) over
    (1 - q) and the product of (1 - q^i), i = 1..m.  With the denominator brought to
    (1 - q^L)^(m+1) a coefficient is at most m + 1 products of a fixed weight and a
    binomial number, so no counts up to u are formed.  Beyond the middle the mirror
    image is summed, which keeps the digits of small tails.
    """
    m, n = smaller, larger
    listed = _rank_sum_tables(up_to)
    beyond = f"2 * {u} > {m} * {n}"
    last = f"CASE WHEN {beyond} THEN {m} * {n} - {u} - 1 ELSE {u} END"
    places = f"transform(f.terms, t -> struct(t.c AS c, {last} - t.k * {n} - t.s AS at))"
    binomial = f"aggregate(sequence(1L, {m}), 1D, (b, i) -> b * CAST(t.at DIV f.period - j + i AS DOUBLE) / i)"
    weight = "element_at(f.weights, CAST(t.at % f.period + j * f.period + 1 AS INT))"
    below = f"aggregate(sequence(0L, {m}), 0D, (s, j) -> s + {weight} * {binomial})"
    count = f"aggregate({places}, 0D, (total, t) -> total + CASE WHEN t.at < 0 THEN 0D ELSE t.c * {below} END)"
    orders = f"aggregate(sequence(1L, {m}), 1D, (b, i) -> b * CAST({n} + i AS DOUBLE) / i)"
    share = f"element_at(transform(slice({listed}, CAST({m} AS INT), 1), f -> {count}), 1) / {orders}"
    return F.expr(f"CASE WHEN {beyond} THEN 1D ELSE 0D END + CASE WHEN {beyond} THEN -1D ELSE 1D END * {share}")

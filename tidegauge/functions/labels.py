"""Labels derived from values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed


def stars(p_value: Column) -> Column:
    """Significance stars; an undefined p (constant input) says so."""
    return (
        F.when(p_value.isNull(), "ns (constant freq)")
        .when(p_value < 0.001, "***")
        .when(p_value < 0.01, "**")
        .when(p_value < 0.05, "*")
        .otherwise("ns")
    )


def fixed_text(value: Column, decimals: int) -> Column:
    """A number as text with a fixed number of decimals; NULL stays NULL.

    The binary value is rounded, half to even, as C's ``%.6f`` does; Spark's
    ``format_string`` would round the shortest decimal text half up.
    """
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", value, F.lit(pattern))


def verdict_text(supported: Column, strength: Column) -> Column:
    """Readable verdict; NULL support is inconclusive."""
    return (
        F.when(supported.isNull(), F.lit("INCONCLUSIVE"))
        .when(supported, F.concat(F.lit("SUPPORTED ("), strength, F.lit(")")))
        .otherwise(F.concat(F.lit("NOT SUPPORTED ("), strength, F.lit(")")))
    )


def strength_score(strength: Column) -> Column:
    """Numeric score of a strength word, 0 for an unknown one."""
    known = F.create_map(
        *[F.lit(part) for pair in fixed.STRENGTH_SCORES.items() for part in pair]
    )
    return F.coalesce(F.try_element_at(known, strength), F.lit(0.0))


def graded(*steps: tuple[Column, str], otherwise: str) -> Column:
    """First matching condition decides the word; a NULL condition does not match."""
    first, *rest = steps
    chain = F.when(first[0], first[1])
    for condition, word in rest:
        chain = chain.when(condition, word)
    return chain.otherwise(otherwise)

"""Expressions over run tags and run-log texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed

WHITESPACE = " \t\n\r\f\u000b"


def tag_candidates(tag: Column, kd: Column) -> Column:
    """Spellings under which a tag may be stored, most likely first.

    Entries whose condition does not hold are NULL and dropped; positions keep
    their order.
    """
    dot = F.lit(".")
    prefix = F.concat(kd, F.lit("-"))
    prefixed = F.startswith(tag, prefix)
    has_comma = F.contains(tag, F.lit(","))
    dotted = F.replace(tag, F.lit(","), dot)
    spellings = F.array(
        tag,
        F.when(~F.endswith(tag, dot), F.concat(tag, dot)),
        F.when(~prefixed, F.concat(prefix, tag)),
        F.when(~prefixed, F.concat(prefix, tag, dot)),
        F.when(prefixed, F.substring(tag, F.length(prefix) + 1, F.length(tag))),
        F.when(has_comma, F.concat(dotted, dot)),
        F.when(has_comma, dotted),
    )
    return F.filter(spellings, lambda one: one.isNotNull())


def log_tag(text: Column) -> Column:
    """Tag named in a run log, without trailing stars and then commas."""
    found = F.nullif(F.regexp_extract(text, fixed.LOG_TAG_PATTERN, 1), F.lit(""))
    return F.regexp_replace(F.regexp_replace(found, r"\*+$", ""), r",+$", "")


def log_window(text: Column, part: int) -> Column:
    """Start (1) or end (2) second announced in a run log."""
    found = F.regexp_extract(text, fixed.LOG_WINDOW_PATTERN, part)
    return F.nullif(found, F.lit("")).try_cast("bigint")


def marker_second(text: Column) -> Column:
    """A marker file holds one integer; anything else is NULL."""
    return F.btrim(text, F.lit(WHITESPACE)).try_cast("bigint")


def run_number(run_dir: Column) -> Column:
    """Trailing number of a run directory name."""
    found = F.regexp_extract(run_dir, fixed.RUN_NUMBER_PATTERN, 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def may_hold_window(line: Column) -> Column:
    """Whether a line can hold a part of the announced window, which may run over lines.

    It opens the announcement, or goes on after a break at one of its blanks: with the
    first number, the dash, or the second number.
    """
    goes_on = r'^\s*("\d+\s*($|-)|-\s*($|\d+")|\d+")'
    return F.contains(line, F.lit('"msg":')) | F.rlike(line, F.lit(goes_on))

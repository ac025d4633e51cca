"""Lenient and strict casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# Texts read as true.
TRUE_TEXTS = ["true", "1", "yes", "sim", "s"]
# Texts that stand for a missing value after a text cast.
MISSING_TEXTS = ["None", "nan", "<NA>"]

INT_MIN, INT_MAX = -2147483648, 2147483647


def lenient_int(c: Column, from_text: bool = True) -> Column:
    """Integer or null, never an error.

    Text rounds half away from zero ("12.5" -> 13); a numeric column rounds half to
    even (12.5 -> 12). Spark's own cast would null the first and truncate the second.
    """
    number = c.cast("string").try_cast("double") if from_text else c.try_cast("double")
    if from_text:
        rounded = F.signum(number) * F.floor(F.abs(number) + F.lit(0.5))
    else:
        rounded = F.rint(number)
    return F.when(rounded.between(INT_MIN, INT_MAX), rounded.cast("int"))


def strict_date(c: Column) -> Column:
    """Date cast that fails on text that is no date (ANSI mode)."""
    return c.cast("date")


def epoch_ms_long(c: Column) -> Column:
    """Epoch milliseconds as BIGINT; null for text that is no number."""
    return F.floor(c.cast("string").try_cast("double")).try_cast("bigint")


def truthy_text(c: Column) -> Column:
    """Text form of a flag: true only for the accepted words, never null."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(TRUE_TEXTS), F.lit(False))


def coerce_number(c: Column, kind: str = "double") -> Column:
    """Number or 0 where the value is missing or no number."""
    zero = F.lit(0).cast(kind)
    return F.coalesce(c.cast("string").try_cast("double").try_cast(kind), zero)


def clean_missing_text(c: Column) -> Column:
    """Text with null and the usual spellings of a missing value as ''."""
    text = c.cast("string")
    return F.when(text.isNull() | text.isin(MISSING_TEXTS), F.lit("")).otherwise(text)


def valid_crm_state(c: Column) -> Column:
    """Two letters after trim and upper-casing; null counts as invalid."""
    return F.coalesce(F.upper(strip(c)).rlike("^[A-Z]{2}$"), F.lit(False))


def valid_crm_number(c: Column) -> Column:
    """Digits only after trim; null counts as invalid."""
    return F.coalesce(strip(c).rlike("^[0-9]+$"), F.lit(False))

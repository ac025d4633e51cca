"""Rounding, ratios and number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sql_round(c: Column, digits: int) -> Column:
    """Half away from zero on the scaled binary value (what ROUND gives in most SQL engines).

    Spark's ``round`` works on the shortest decimal text, so 1.005 becomes 1.01 there.
    """
    scale = F.lit(float(10 ** digits))
    return F.signum(c) * F.floor(F.abs(c.cast("double")) * scale + F.lit(0.5)) / scale


def python_round(c: Column, digits: int) -> Column:
    """Half to even on the exact binary value; the number format uses that rule."""
    return F.translate(F.format_number(c.cast("double"), digits), ",", "").cast("double")


def ratio(top: Column, bottom: Column, digits: int = 1, scale: float = 1.0) -> Column:
    """``top / bottom * scale`` rounded, 0.0 where the bottom is not positive."""
    value = top.cast("double") / F.when(bottom > 0, bottom.cast("double"))
    return F.coalesce(python_round(value * F.lit(scale), digits), F.lit(0.0))


def locale_int(c: Column) -> Column:
    """1234567 -> '1.234.567'."""
    return F.translate(F.format_number(c, 0), ",", ".")


def locale_decimal(c: Column, digits: int = 1) -> Column:
    """12.5 -> '12,5' (no grouping)."""
    return F.translate(F.translate(F.format_number(c.cast("double"), digits), ",", ""), ".", ",")


def signed_text(c: Column, digits: int = 1) -> Column:
    """Always signed fixed-point text, e.g. '+0.4'."""
    plain = F.translate(F.format_number(c.cast("double"), digits), ",", "")
    return F.when(plain.startswith("-"), plain).otherwise(F.concat(F.lit("+"), plain))


def rate_band(c: Column, low: float, high: float) -> Column:
    """'low' below the first limit, 'mid' up to the second (inclusive), 'high' above it."""
    return F.when(c.isNull(), None).when(c < low, "low").when(c <= high, "mid").otherwise("high")

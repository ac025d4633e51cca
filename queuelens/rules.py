"""Business rules of the waiting list, all of them parameters with defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Rules:
    # Default limits.
    sla_days: int = 180
    urgent_colours: tuple[str, ...] = ("VERMELHO", "LARANJA", "AMARELO")
    commercial_month: float = 30.416
    freshness_hours: float = 2.0
    age_min: int = 0
    age_max: int = 120
    severity_line: int = 40
    breaker_ratio: float = 0.05
    breaker_min_rows: int = 100


DEFAULT_RULES = Rules()


def as_date(as_of) -> Column:
    """``as_of`` as a date column; every report takes it instead of the current date."""
    return as_of.cast("date") if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")

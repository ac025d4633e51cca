"""Filter predicates as Columns.

User values only ever enter as literals, never as SQL text. ``&``, ``|`` and ``~``
combine predicates with SQL's three-valued logic.
"""

from __future__ import annotations

import unicodedata
import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import (day_diff, fold_accents, lenient_int, search_terms, strip)
from ..rules import as_date

# Fixed value: pseudo outcome of requests that have none yet.
IN_PROGRESS = "EM ANDAMENTO"

# The values read out of the pending-reason text.
PENDING_PATTERNS = {
    "tipo": "'tipo': '([^']+)'",
    "descricao": "'descricao': '([^']+)'",
    "status": "'status': '([^']+)'",
}


def all_of(clauses: Iterable[Column | None]) -> Column:
    """Conjunction; no clause (or only empty ones) means 'always true'."""
    return reduce(lambda a, b: a & b, [c for c in clauses if c is not None], F.lit(True))


def any_of(clauses: Iterable[Column]) -> Column:
    clauses = list(clauses)
    return reduce(lambda a, b: a | b, clauses) if clauses else F.lit(True)


# --- domain rules ---------------------------------------------------------------

def urgent(colour: Column, colours: Iterable[str], ignore_case: bool = False) -> Column:
    """Risk colour in the urgent list (case-sensitive unless asked otherwise)."""
    return (F.upper(colour) if ignore_case else colour).isin(list(colours))


def waiting_longer(requested: Column, as_of, days: int) -> Column:
    """More than ``days`` calendar days between the request and ``as_of`` (strict)."""
    return day_diff(as_date(as_of), requested) > days


# --- sets, flags and ranges -------------------------------------------------------

def include(c: Column, values: Iterable) -> Column | None:
    values = list(values)
    return c.isin(values) if values else None


def exclude(c: Column, values: Iterable) -> Column | None:
    """NOT IN: rows with a null value drop out."""
    values = list(values)
    return ~c.isin(values) if values else None


def is_yes(c: Column) -> Column:
    return c == F.lit(True)


def is_no(c: Column) -> Column:
    return (c == F.lit(False)) | c.isNull()


def present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def absent(c: Column) -> Column:
    return c.isNull() | (c == "")


def int_range(c: Column, low: int, high: int, from_text: bool = True) -> Column:
    return lenient_int(c, from_text).between(low, high)


def value_range(c: Column, low, high) -> Column:
    return c.between(low, high)


def date_range(c: Column, start=None, end=None, as_of=None, default_days: int = 30) -> Column | None:
    """Inclusive day range. With only ``as_of`` it is the last ``default_days`` days.

    A timestamp column is compared with the bounds directly (first instant of the first
    day up to the first instant after the last), so the scan can prune on it.
    """
    if start is None or end is None:
        if as_of is None:
            return None
        end_col = as_date(as_of)
        start_col = F.date_sub(end_col, default_days)
    else:
        start_col, end_col = as_date(start), as_date(end)
    return (c >= start_col) & (c < F.date_add(end_col, 1))


# --- text -------------------------------------------------------------------------

def matches(folded: Column, pattern: str) -> Column:
    """LIKE on text that went through ``folded_text``; a backslash is a plain character."""
    bare = "".join(x for x in unicodedata.normalize("NFD", pattern.lower())
                   if not unicodedata.category(x).startswith("M"))
    return folded.like(unicodedata.normalize("NFC", bare).replace("\\", "\\\\"))


def folded_text(c: Column) -> Column:
    """Lower case without accents, the form search terms are compared in."""
    return fold_accents(F.lower(c))


def _on_folded(c: Column, test: Callable[[Column], Column]) -> Column:
    """``test`` of the folded text, folding a long text once for all its terms."""
    return F.element_at(F.transform(F.array(folded_text(c)), test), 1)


def text_any(c: Column, terms: str) -> Column | None:
    patterns = search_terms(terms)
    return _on_folded(c, lambda t: any_of([matches(t, p) for p in patterns])) if patterns else None


def text_all(c: Column, terms: str) -> Column | None:
    patterns = search_terms(terms)
    return _on_folded(c, lambda t: all_of([matches(t, p) for p in patterns])) if patterns else None


def text_none(c: Column, terms: str) -> Column | None:
    patterns = search_terms(terms)
    return _on_folded(c, lambda t: all_of([~matches(t, p) for p in patterns])) if patterns else None


def contains_ignoring_case(c: Column, text: str) -> Column:
    return c.ilike("%" + text.replace("\\", "\\\\") + "%")


def entity_text(df: DataFrame, key: str, column: str, any_terms: str = "", all_terms: str = "",
                no_terms: str = "") -> DataFrame:
    """Rows whose entity has matching text in *any* of its rows.

    One pass of ``bool_or`` per term (combined before the shuffle, so a huge entity costs
    one row per map task), then a left-semi join back on the key. Entities whose texts
    are all null satisfy neither a positive nor a negative term.
    """
    def hits(terms: str) -> list[Column]:
        return [F.bool_or(matches(F.col("__text"), p)) for p in search_terms(terms)]

    flags: list[Column] = []
    clauses: list[Column] = []

    def flag(expression: Column) -> Column:
        flags.append(expression.alias(f"__f{len(flags)}"))
        return F.col(f"__f{len(flags) - 1}")

    any_hits = [flag(h) for h in hits(any_terms)]
    if any_hits:
        clauses.append(any_of(any_hits))
    clauses += [flag(h) for h in hits(all_terms)]
    clauses += [flag(h) == F.lit(False) for h in hits(no_terms)]
    if not clauses:
        return df
    keys = (df.select(key, folded_text(F.col(column)).alias("__text"))
            .groupBy(key).agg(*flags).filter(all_of(clauses)).select(key))
    return df.join(keys, key, "left_semi")


# --- outcome and pending reason -----------------------------------------------------

def outcome_include(c: Column, values: Iterable[str]) -> Column | None:
    values = list(values)
    if not values:
        return None
    real = [v for v in values if v != IN_PROGRESS]
    parts = [absent(c)] if IN_PROGRESS in values else []
    if real:
        parts.append(c.isin(real))
    return any_of(parts)


def outcome_exclude(c: Column, values: Iterable[str]) -> Column | None:
    values = list(values)
    if not values:
        return None
    real = [v for v in values if v != IN_PROGRESS]
    parts = [present(c)] if IN_PROGRESS in values else []
    if real:
        parts.append(~c.isin(real))
    return all_of(parts)


def pending_value(c: Column, field: str) -> Column:
    """One value of the dict-like pending-reason text, '' where it is missing."""
    return F.regexp_extract(c, PENDING_PATTERNS[field], 1)


def pending_match(c: Column, values: Iterable[str]) -> Column | None:
    """Any of the values occurs in the text, upper and lower case alike.

    Every character of a value that has a meaning in patterns is quoted.
    """
    quoted = [re.sub(r"([^\w\s])", r"\\\1", v) for v in values]
    return c.rlike("(?i)(" + "|".join(quoted) + ")") if quoted else None


def pending_no_match(c: Column, values: Iterable[str]) -> Column | None:
    found = pending_match(c, values)
    return None if found is None else ~found


# --- key gates ------------------------------------------------------------------------

def valid_key(c: Column) -> Column:
    """Trimmed key is not empty; null keys pass and form one group."""
    return c.isNull() | (strip(c.cast("string")) != "")


def valid_legacy_key(c: Column) -> Column:
    return F.coalesce(c.contains("-"), F.lit(False))


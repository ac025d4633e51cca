"""SQL-text forms of the functions that wide projections repeat for many columns.

A projection of a hundred columns built from single ``Column`` calls needs thousands of
round trips to the JVM before the query even starts; one SQL expression per column needs
one. Arguments are expressions of the library's own (paths, column names), never user values.
"""

from __future__ import annotations

from .casts import TRUE_TEXTS
from .dates import EPOCH_MS_MAX, EPOCH_MS_MIN, SECOND_FORMAT
from .text import STRIP_REGEX

# White space of a regex, as a set of characters: no text is decoded to look at its first one.
BLANKS = r" \t\n\u000B\u000C\r"


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def blank(x: str) -> str:
    return f"coalesce({x}, '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, r'{STRIP_REGEX}', '')"


def first_filled(a: str, b: str) -> str:
    """The first value unless it is missing or '', else the second, else ''."""
    return f"coalesce(nullif({a}, ''), {b}, '')"


def epoch_ms(x: str) -> str:
    return f"floor(try_cast({x} AS DOUBLE))"


def ms_text(ms: str, fmt: str = SECOND_FORMAT) -> str:
    ok = f"{ms} <> 0 AND {ms} BETWEEN {EPOCH_MS_MIN} AND {EPOCH_MS_MAX}"
    return f"coalesce(date_format(CASE WHEN {ok} THEN timestamp_millis({ms}) END, '{fmt}'), '')"


def epoch_text(x: str, fmt: str = SECOND_FORMAT) -> str:
    return ms_text(epoch_ms(x), fmt)


def hash_identity(x: str, salt: str) -> str:
    """``salt`` is the name of a column that holds the salt."""
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' "
            f"ELSE sha2(concat(lower({strip(x)}), {salt}), 256) END")


def format_key(x: str) -> str:
    parts = ", ".join(f"substring({x}, {start}, {n})" for start, n in [(1, 2), (3, 2), (5, 7), (12, 1)])
    return f"CASE WHEN length({x}) = 12 THEN concat_ws('-', {parts}) ELSE coalesce({x}, '') END"


def truthy_variant(v: str) -> str:
    """Flag of a JSON value: word list for text, non-zero for numbers, non-empty for objects
    and arrays, false for null and for a missing value."""
    text = f"try_variant_get({v}, '$', 'string')"
    return f"""CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN FALSE
      WHEN schema_of_variant({v}) = 'BOOLEAN' THEN try_variant_get({v}, '$', 'boolean')
      WHEN schema_of_variant({v}) = 'STRING'
        THEN coalesce(lower({strip(text)}) IN ({quoted(TRUE_TEXTS)}), FALSE)
      WHEN schema_of_variant({v}) LIKE 'OBJECT%' OR schema_of_variant({v}) LIKE 'ARRAY%'
        THEN to_json({v}) NOT IN ('{{}}', '[]')
      ELSE coalesce(try_variant_get({v}, '$', 'double') <> 0, FALSE) END"""


def normalise_breaks(x: str) -> str:
    return rf"replace(replace(replace({x}, '\r\n', ' '), '\r', ' '), '\n', '  ')"


def unify_breaks(x: str) -> str:
    return rf"replace(replace({x}, '\r\n', '\n'), '\r', '\n')"


def python_round(x: str, digits: int) -> str:
    return f"CAST(translate(format_number({x}, {digits}), ',', '') AS DOUBLE)"

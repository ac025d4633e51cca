"""Text functions: accent folding, line breaks, labels and search terms."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Placeholder label and label width.
NOT_INFORMED = "Não Informado"
LABEL_WIDTH = 45

# White space of any kind at either end, as Unicode defines it.
STRIP_REGEX = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


@lru_cache(maxsize=2)
def _accent_table(form: str) -> tuple[str, str]:
    """``translate`` arguments that drop marks from every BMP character.

    Built by rule from the Unicode database: one-to-one replacements first, then the
    combining marks, which have no partner and are therefore deleted.
    """
    source, target, dropped = [], [], []
    for code in range(0x00A8, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        bare = "".join(x for x in unicodedata.normalize(form, char)
                       if not unicodedata.category(x).startswith("M"))
        bare = unicodedata.normalize("NFC", bare)
        if bare == char:
            continue
        if not bare:
            dropped.append(char)
        elif len(bare) == 1:
            source.append(char)
            target.append(bare)
    return "".join(source + dropped), "".join(target)


def fold_accents(c: Column) -> Column:
    """Canonical accent removal: é -> e, while ø, ß and ligatures stay."""
    source, target = _accent_table("NFD")
    return F.translate(c, source, target)


def fold_compat(c: Column) -> Column:
    """Compatibility accent removal: also ª -> a, full-width forms and f-ligatures."""
    source, target = _accent_table("NFKD")
    folded = F.translate(c, source, target)
    for ligature in "ﬀﬁﬂﬃﬄﬅﬆ":
        folded = F.replace(folded, F.lit(ligature),
                           F.lit(unicodedata.normalize("NFKD", ligature)))
    return folded


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, STRIP_REGEX, "")


def normalise_breaks(c: Column) -> Column:
    r"""'\r\n' and '\r' become one blank, '\n' becomes two."""
    out = c
    for found, put in (("\r\n", " "), ("\r", " "), ("\n", "  ")):
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def unify_breaks(c: Column) -> Column:
    r"""Every line break becomes '\n'."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def truncate_label(c: Column, width: int = LABEL_WIDTH) -> Column:
    return F.when(F.length(c) > width,
                  F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def blank_label(c: Column, prefix: str = "") -> Column:
    """Null and '' become the placeholder label, with an optional '<prefix> ' before it."""
    label = f"{prefix} {NOT_INFORMED}" if prefix else NOT_INFORMED
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(label))


def format_key(c: Column) -> Column:
    """12-character keys as 'nn-nn-nnnnnnn-n', others as they are, missing as ''."""
    text = c.cast("string")
    parts = F.concat_ws("-", F.substring(text, 1, 2), F.substring(text, 3, 2),
                        F.substring(text, 5, 7), F.substring(text, 12, 1))
    return F.when(text.isNull(), F.lit("")).when(F.length(text) == 12, parts).otherwise(text)


def like_pattern(term: str | None) -> str:
    """Search term to LIKE pattern: '*' is the wildcard, no '*' means 'contains'."""
    term = (term or "").strip()
    if not term:
        return ""
    return term.replace("*", "%") if "*" in term else f"%{term}%"


def search_terms(text: str | None) -> list[str]:
    """Comma-separated terms, blanks dropped, each as LIKE pattern."""
    return [like_pattern(t) for t in (text or "").split(",") if t.strip()]


def regex_group(c: Column, pattern: str, group: int) -> Column:
    """One capture group, null (not '') where the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def key_value_lines(c: Column) -> Column:
    """'key: value' lines as a map, split at the first colon; the last line of a key wins."""
    lines = F.filter(F.split(c, "\n"), lambda line: line.contains(":"))
    pairs = F.transform(lines, lambda line: F.struct(
        strip(F.substring_index(line, ":", 1)).alias("key"),
        strip(F.regexp_replace(line, r"^[^:]*:", "")).alias("value")))
    # the map is filled from the last line backwards, keeping the first entry per key
    return F.aggregate(
        F.reverse(pairs), F.create_map().cast("map<string,string>"),
        lambda acc, p: F.when(F.map_contains_key(acc, p["key"]), acc)
        .otherwise(F.map_concat(acc, F.create_map(p["key"], p["value"]))))

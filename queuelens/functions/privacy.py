"""One-way salted hashes of direct identifiers. The salt is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip


def hash_identity(c: Column, salt: str) -> Column:
    """Hash of the stripped lower-case text; '' for a missing value."""
    text = c.cast("string")
    digest = F.sha2(F.concat(F.lower(strip(text)), F.lit(salt)), 256)
    return F.when(text.isNull() | (text == ""), F.lit("")).otherwise(digest)


def hash_raw(c: Column, salt: str) -> Column:
    """Hash of the text as it is; null for null and ''."""
    text = c.cast("string")
    return F.when(text != "", F.sha2(F.concat(text, F.lit(salt)), 256))

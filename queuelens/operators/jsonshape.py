"""Schema-driven reshaping of nested data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def flatten_struct(df: DataFrame, separator: str = "_") -> DataFrame:
    """Every leaf of every struct as one column named by its path; arrays stay as they are."""
    def leaves(path: list[str], kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in leaves(path + [f.name], f.dataType)]
        return [F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path))]
    return df.select(*[c for f in df.schema.fields for c in leaves([f.name], f.dataType)])


def millis_to_timestamps(df: DataFrame, hints: tuple[str, ...] = ("data", "versao")) -> DataFrame:
    """Numeric columns whose name holds one of the hints, read as epoch milliseconds."""
    found = {f.name: F.timestamp_millis(F.col(f"`{f.name}`").cast("bigint")) for f in df.schema.fields
             if isinstance(f.dataType, T.NumericType) and any(h in f.name.lower() for h in hints)}
    return df.withColumns(found) if found else df


def record_lines(df: DataFrame, key: str) -> DataFrame:
    """Record set turned on its side: one row per (key, column, value as text)."""
    rest = [c for c in df.columns if c != key]
    as_text = df.select(key, *[F.col(f"`{c}`").cast("string").alias(c) for c in rest])
    return as_text.unpivot(key, rest, "column", "value")

"""Batch jobs: CSV consolidation and raw-store conversion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions import hash_raw
from ..operators.contract import ROOT_FIELDS, errors_expression, with_errors
from ..operators.dedup import keep_last
from ..schema import DIRECT_IDENTIFIERS, TEXT_EXPORT_COLUMNS
from ..sources.files import load_csv, write_parquet
from ..sources.layout import can_cluster, write_clustered
from .flatten import canonical, flatten, typed


def anonymise(df: DataFrame, salt: str, columns: Iterable[str] = DIRECT_IDENTIFIERS) -> DataFrame:
    """Hash the listed columns that exist; '' and null become null."""
    found = {c: hash_raw(F.col(f"`{c}`"), salt) for c in columns if c in df.columns}
    return df.withColumns(found) if found else df


def clean(df: DataFrame, key: str = "numeroCMCE",
          position: tuple[str, ...] = ("source_file", "row_seq")) -> DataFrame:
    """Last row per valid key in source order; a frame without the key is left alone."""
    return keep_last(df, key, list(position)) if key in df.columns else df


def export_text(df: DataFrame, columns: Iterable[str] = TEXT_EXPORT_COLUMNS) -> DataFrame:
    """Columns of mixed content as text, missing values as ''."""
    found = {c: F.when(F.col(c).cast("string") == "nan", "").otherwise(
        F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns if c in df.columns}
    return df.withColumns(found) if found else df


def consolidate(spark: SparkSession, pattern: str, salt: str) -> tuple[DataFrame, DataFrame, Observation]:
    """Load, de-duplicate and anonymise CSV files: (rows, skipped files, row counter).

    The observation counts the loaded rows while the result is written, so the number of
    removed rows needs no extra pass.
    """
    loaded, errors = load_csv(spark, pattern)
    seen = Observation("loaded")
    counted = loaded.observe(seen, F.count(F.lit(1)).alias("rows"))
    return export_text(anonymise(clean(counted), salt)), errors, seen


def run_consolidation(spark: SparkSession, pattern: str, target: str, salt: str) -> dict[str, int]:
    rows, errors, seen = consolidate(spark, pattern, salt)
    kept = Observation("kept")
    _write(rows.observe(kept, F.count(F.lit(1)).alias("rows")), target)
    loaded = seen.get["rows"]
    return {"loaded": loaded, "kept": kept.get["rows"], "removed": loaded - kept.get["rows"],
            "skipped_files": errors.count()}


def _write(rows: DataFrame, target: str) -> None:
    """Clustered by date and list where the table has them, so that filters on those skip row groups."""
    if can_cluster(rows):
        write_clustered(rows, target)
    else:
        write_parquet(rows, target)


def convert_raw(raw: DataFrame, as_of, salt: str) -> tuple[DataFrame, DataFrame]:
    """Raw documents to the typed request table and the rows that could not be converted.

    A row fails when it is no JSON object, its history is no list, or it has no key.
    """
    checked = _convertible(raw)
    return (typed(canonical(flatten(checked.filter("usable"), as_of, salt))),
            checked.filter("NOT usable").drop("usable"))


def _convertible(raw: DataFrame) -> DataFrame:
    # the verdict comes from these checks alone; all errors are listed for the rows that are asked for them
    broken = F.expr(errors_expression("conteudo_json", root=ROOT_FIELDS[:1], blocks={}, event_fields=[]))
    unusable = F.exists(broken, lambda e: e.startswith("payload") | e.startswith("document")
                        | e.startswith("numeroCMCE: missing") | (e == "evolucoes: wrong type")
                        | (e == "evolucoes: null"))
    return with_errors(raw).withColumn("usable", ~unusable)


def run_conversion(raw: DataFrame, target: str, as_of, salt: str) -> dict[str, int]:
    """Convert and write; both counters come from the one pass that writes."""
    done = Observation("converted")
    checked = _convertible(raw).observe(done, F.count_if("usable").alias("rows"),
                                        F.count_if(~F.col("usable")).alias("errors"))
    _write(typed(canonical(flatten(checked.filter("usable"), as_of, salt))), target)
    return {"converted": done.get["rows"], "errors": done.get["errors"]}

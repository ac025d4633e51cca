"""Parquet and CSV datasets."""

from __future__ import annotations

import csv
import uuid
from collections import defaultdict
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import day_first_timestamp
from ..operators.contract import require_columns
from ..schema import DATE_COLUMNS

BOM = "\ufeff"


# --- readers ----------------------------------------------------------------------------

def object_store_options(region: str, endpoint: str | None = None) -> dict[str, str]:
    """Hadoop settings for ``s3a://`` paths; credentials come from the platform's provider."""
    options = {"fs.s3a.endpoint.region": region}
    return options | ({"fs.s3a.endpoint": endpoint} if endpoint else {})


def read_requests(spark: SparkSession, path: str, view: str | None = None, check: bool = True,
                  options: dict[str, str] | None = None) -> DataFrame:
    """Open a request dataset, check its columns, name it as a view.

    For an object store pass ``object_store_options`` as ``options``.
    """
    df = spark.read.options(**(options or {})).parquet(path)
    if check:
        require_columns(df)
    if view:
        df.createOrReplaceTempView(view)
    return df


def schema_table(df: DataFrame) -> DataFrame:
    """(column_name, type) of a frame."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name STRING, type STRING")


def with_lineage(df: DataFrame) -> DataFrame:
    """Full path of the source file and load time of every row."""
    return df.withColumns({"source_file": F.col("_metadata.file_path"),
                           "ingestion_at": F.current_timestamp()})


def _file_system(spark: SparkSession, path: str):
    """(file system, path object) of the cluster's storage for a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def size_of(spark: SparkSession, files: Iterable[str]) -> int:
    """Bytes of some files, named as ``DataFrame.inputFiles`` names them; one listing per folder, nothing is opened."""
    wanted = {_plain(f) for f in files}
    folders = {f.rsplit("/", 1)[0] for f in wanted}
    total = 0
    for folder in folders:
        fs, where = _file_system(spark, folder)
        total += sum(s.getLen() for s in fs.listStatus(where) if _plain(s.getPath().toString()) in wanted)
    return total


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a glob, empty ones included; nothing is opened."""
    fs, where = _file_system(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(where) or [] if s.isFile())


def list_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a glob."""
    fs, where = _file_system(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(where) or [] if s.isDirectory())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def _headers(spark: SparkSession, pattern: str) -> dict[str, str]:
    """First line of every non-empty file of a glob, in one job."""
    lines = spark.read.text(pattern).select(
        F.col("_metadata.file_path").alias("path"), "value",
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("line"))
    return {_plain(r.path): r.line.removeprefix(BOM) for r in first.collect()}  # one row per file


def _plain(path: str) -> str:
    """A path without escapes, as the file system lists it."""
    return unquote(path.replace("file:///", "file:/"))


def load_csv(spark: SparkSession, pattern: str, required: Iterable[str] = DATE_COLUMNS,
             dates: Iterable[str] = DATE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """All CSV files of a glob as one frame, and a frame of skipped files with the reason.

    The headers are read in one job, and files are grouped by header, so the number of scans
    is the number of distinct layouts and not the number of files. Every column is read as
    text; date columns are parsed day first. ``source_file`` is the full path and ``row_seq``
    orders the rows of a file as they stand in it. Fields may hold line breaks, so a file is
    read by one task; large sources come in many files.
    """
    paths, required = list_files(spark, pattern), list(required)
    first = _headers(spark, pattern) if paths else {}
    headers = {path: tuple(next(csv.reader([first[key]]), ())) if (key := _plain(path)) in first else ()
               for path in paths}
    layouts: dict[tuple[str, ...], list[str]] = defaultdict(list)
    skipped: list[tuple[str, str]] = []
    for path, header in headers.items():
        missing = sorted(set(required) - set(header)) if header else []
        if not header:
            skipped.append((path, "unreadable or empty"))
        elif missing:
            skipped.append((path, f"columns missing: {missing}"))
        else:
            layouts[header].append(path)
    frames = []
    for header, files in sorted(layouts.items()):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        frame = (spark.read.schema(schema)
                 .options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8",
                          mode="PERMISSIVE")
                 .csv(files))
        parsed = {c: day_first_timestamp(F.col(f"`{c}`")) for c in dates if c in header}
        frames.append(with_lineage(frame).withColumn("row_seq", F.monotonically_increasing_id())
                      .withColumns(parsed))
    errors = spark.createDataFrame(skipped, "path STRING, reason STRING")
    if not frames:
        return spark.createDataFrame([], "source_file STRING"), errors
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged, errors


# --- writers ----------------------------------------------------------------------------

def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", quote_all: bool = False,
              bom: bool = False, mode: str = "overwrite", max_rows: int | None = None) -> None:
    """CSV with header. ``bom`` marks the file as UTF-8 for spreadsheet programs, ``max_rows``
    bounds the rows of a file."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    writer = df.write.option("maxRecordsPerFile", max_rows) if max_rows else df.write
    writer.mode(mode).options(header=True, sep=sep, quoteAll=quote_all, escape='"',
                                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                                encoding="UTF-8").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    return (spark.read.schema(schema).options(header=True, sep=sep, multiLine=True, quote='"', escape='"',
                                              encoding="UTF-8").csv(path))


def swap_in(df: DataFrame, path: str) -> None:
    """Write beside the target, then put the new dataset in its place by rename.

    Readers see the old or the new dataset, never a half-written one, and the frame may be
    derived from the dataset it replaces.
    """
    spark = df.sparkSession
    staged, retired = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.retired-{uuid.uuid4().hex}"
    write_parquet(df, staged, "errorifexists")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs, target = _file_system(spark, path)
    if fs.exists(target) and not fs.rename(target, fs_path(retired)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(fs_path(staged), target):
        fs.rename(fs_path(retired), target)
        raise OSError(f"cannot move {staged} to {path}")
    fs.delete(fs_path(retired), True)


def ensure_dataset(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Create an empty dataset unless there is one."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def write_column_files(frequencies: DataFrame, path: str) -> None:
    """One CSV folder per column from a (column, value, count) frame."""
    (frequencies.write.mode("overwrite").partitionBy("column")
     .options(header=True, sep=";", encoding="UTF-8").csv(path))

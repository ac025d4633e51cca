"""Latest-wins rules, incremental cuts and sampled groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .predicates import valid_key


def top_per_group(df: DataFrame, group: str | list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group. Each map task drops all but its own first ``n`` rows per
    group before the shuffle (window group limit), so a huge group costs little."""
    groups = [group] if isinstance(group, str) else group
    ranked = df.withColumn("row_num", F.row_number().over(
        Window.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col("row_num") <= n).drop("row_num")


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (pass descending columns for 'newest')."""
    return top_per_group(df, key, order, 1)


def keep_last(df: DataFrame, key: str, position: list[str]) -> DataFrame:
    """Drop rows without a usable key, then keep the last row per key in source order."""
    return latest_per_key(df.filter(valid_key(F.col(key))), key,
                          [F.col(p).desc_nulls_last() for p in position])


def keyed_merge(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Old and new rows by key; new rows win, among themselves the first in ``order``."""
    both = old.withColumn("__new", F.lit(0)).unionByName(
        new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, key, [F.desc("__new"), *order]).drop("__new")


def not_yet_processed(new: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return new.join(processed.select(key), key, "left_anti")


def watermarks(raw: DataFrame, as_of=None, days_back: int = 7) -> DataFrame:
    """Highest change stamp per list. Without one: 0, or ``days_back`` days before ``as_of``."""
    fallback = F.lit(0) if as_of is None else F.unix_millis(
        F.date_sub(F.lit(str(as_of)).cast("date"), days_back).cast("timestamp"))
    return raw.groupBy("origem_lista").agg(
        F.coalesce(F.max("data_alteracao"), fallback).cast("bigint").alias("watermark"))


def incremental_cut(rows: DataFrame, marks: DataFrame, full_sync_done: bool = True,
                    mark_only: str | None = None) -> DataFrame:
    """Rows newer than their list's watermark; rows without a stamp always stay.

    Before the first full sync nothing is cut. The watermark frame has one row per list.
    ``mark_only`` names a flag column for the rows to cut, which then stay as well.
    """
    stamp, mark = F.coalesce("data_alteracao", F.lit(0)), F.coalesce("watermark", F.lit(0))
    seen = (mark > 0) & (stamp > 0) & (stamp <= mark) & F.lit(full_sync_done)
    flagged = rows.join(marks, "origem_lista", "left").withColumn(mark_only or "__seen", seen).drop("watermark")
    return flagged if mark_only else flagged.filter("NOT __seen").drop("__seen")

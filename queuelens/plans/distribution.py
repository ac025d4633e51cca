"""Waits per request and their distribution figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import day_diff
from ..rules import as_date

MEASURES = ["dias_fila", "dias_esquecido"]


def waits(df: DataFrame, predicate: Column | None, as_of) -> DataFrame:
    """Days since the first request and days since the last event, per request."""
    rows = df if predicate is None else df.filter(predicate)
    day = as_date(as_of)
    return rows.groupBy("numeroCMCE").agg(
        day_diff(day, F.min(F.col("dataSolicitacao").cast("date"))).alias("dias_fila"),
        day_diff(day, F.max(F.col("dataCadastro").cast("date"))).alias("dias_esquecido"),
    )


def day_histogram(waits_df: DataFrame) -> DataFrame:
    """(measure, days, n): at most one row per calendar day of the data's span.

    The percentile figures below work on this small frame, so no task ever holds the
    waits of all requests.
    """
    return (waits_df.unpivot("numeroCMCE", MEASURES, "measure", "days")
            .filter("days IS NOT NULL").groupBy("measure", "days")
            .agg(F.count(F.lit(1)).alias("n")))


def _quantile(p: float) -> Column:
    return F.percentile(F.col("days"), p, F.col("n"))


def _with_quartiles(histogram: DataFrame) -> DataFrame:
    over = Window.partitionBy("measure")
    return histogram.withColumns({"q1": _quantile(0.25).over(over),
                                  "q3": _quantile(0.75).over(over)})


def deciles(waits_df: DataFrame) -> DataFrame:
    """Quartiles, P10, P90 and the number of requests inside the 3 x IQR upper fence."""
    hist = _with_quartiles(day_histogram(waits_df))
    inside = F.col("days") <= F.col("q3") + 3.0 * (F.col("q3") - F.col("q1"))
    return hist.groupBy("measure").agg(
        F.sum("n").alias("n"), F.max("q1").alias("q1"), F.max("q3").alias("q3"),
        _quantile(0.1).alias("p10"), _quantile(0.9).alias("p90"),
        F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("n_inside"))


def boxplot(waits_df: DataFrame) -> DataFrame:
    """Five box-plot figures of the values inside the 3 x IQR upper fence.

    Whisker ends are the extreme values inside 1.5 x IQR, or the plain extremes where no
    value lies inside.
    """
    raw = _with_quartiles(day_histogram(waits_df))
    clean = raw.filter(F.col("days") <= F.col("q3") + 3.0 * (F.col("q3") - F.col("q1")))
    box = _with_quartiles(clean.drop("q1", "q3"))
    step = 1.5 * (F.col("q3") - F.col("q1"))
    days = F.col("days")
    return box.groupBy("measure").agg(
        F.coalesce(F.min(F.when(days >= F.col("q1") - step, days)), F.min(days)).alias("low_fence"),
        F.max("q1").alias("q1"), _quantile(0.5).alias("median"), F.max("q3").alias("q3"),
        F.coalesce(F.max(F.when(days <= F.col("q3") + step, days)), F.max(days)).alias("high_fence"))


def seeded_sample(df: DataFrame, key: str, n: int = 10000, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the same ones on every run and on every partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))),
                      F.col(key)).limit(n)

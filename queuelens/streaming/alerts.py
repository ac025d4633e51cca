"""Operational alert rules as windowed aggregations.

Each function works on a stream and on a batch frame alike. With a watermark a stream drops
rows later than that (counted in ``numRowsDroppedByWatermark``) and frees old windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Alert limits and histogram bounds.
ERROR_RATE = 0.1
DURATION_LIMIT = 10800.0
HEARTBEAT_SECONDS = 100000
HIGH_RISK_LIMIT = 500
FETCH_BUCKETS = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 240.0]


def _late(df: DataFrame, watermark: str | None) -> DataFrame:
    return df.withWatermark("ts", watermark) if watermark and df.isStreaming else df


def error_rate(df: DataFrame, failed: Column, group: str, watermark: str | None = None,
               size: str = "15 minutes", slide: str = "5 minutes") -> DataFrame:
    """Sliding error share per group with an alert flag."""
    counts = _late(df, watermark).groupBy(F.window("ts", size, slide), group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("errors"))
    return counts.select(F.col("window.start").alias("start"), group, "n", "errors",
                         (F.col("errors") / F.col("n") > ERROR_RATE).alias("alert"))


def duration_p90(df: DataFrame, duration: str, watermark: str | None = None, size: str = "1 hour",
                 limit: float = DURATION_LIMIT) -> DataFrame:
    """P90 of run durations per tumbling window with an alert flag."""
    p90 = _late(df, watermark).groupBy(F.window("ts", size)).agg(
        F.percentile_approx(duration, 0.9, 100000).alias("p90"), F.count(F.lit(1)).alias("n"))
    return p90.select(F.col("window.start").alias("start"), "n", "p90", (F.col("p90") > limit).alias("alert"))


def bucket(duration: Column, bounds: list[float] | None = None) -> Column:
    """Upper bound of the histogram bucket as text, '+Inf' above the last one."""
    out = F.lit("+Inf")
    for bound in reversed(bounds or FETCH_BUCKETS):
        out = F.when(duration <= bound, str(bound)).otherwise(out)
    return out


def counters(df: DataFrame, kind: str, group: str, duration: str, watermark: str | None = None,
             size: str = "1 day") -> DataFrame:
    """Items per window, kind, group and duration bucket."""
    counted = _late(df, watermark).groupBy(
        F.window("ts", size), kind, group, bucket(F.col(duration)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(duration).alias("seconds"))
    return counted.select(F.col("window.start").alias("start"), kind, group, "bucket", "n", "seconds")


def last_seen(df: DataFrame, group: str, ok: Column, high_risk: Column) -> DataFrame:
    """Last event, last success and high-risk count per group: the heartbeat figures."""
    return df.groupBy(group).agg(F.max("ts").alias("last_ts"), F.max(F.when(ok, F.col("ts"))).alias("last_ok"),
                                 F.count_if(high_risk).alias("high_risk"))


def heartbeat(seen: DataFrame, now, freshness_hours: float = 2.0, stall_hours: float = 6.0) -> DataFrame:
    """Alert flags of the heartbeat figures at one point in time; a group that never
    succeeded is stale and stalled."""
    clock = F.lit(str(now)).cast("timestamp")

    def seconds_since(c: str) -> Column:
        return (F.unix_millis(clock) - F.unix_millis(c)) / 1000.0

    return seen.withColumns({
        "stale": F.coalesce(seconds_since("last_ok") > HEARTBEAT_SECONDS, F.lit(True)),
        "not_fresh": seconds_since("last_ts") > freshness_hours * 3600,
        "stalled": F.coalesce(seconds_since("last_ok") >= stall_hours * 3600, F.lit(True)),
        "risk_surge": F.col("high_risk") > HIGH_RISK_LIMIT})

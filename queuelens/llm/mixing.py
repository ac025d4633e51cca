"""Mixing sources to target weights by Poisson replication.

Every source has a size, the sum of ``length(text) + 1`` over its rows (a null text has length 0), and a target
weight (default: all sources alike; a source that ``weights`` does not name gets ``other``). Its mean repetition rate
is ``weight / sum of weights * budget / size``, with the sum over the sources that are there and the sizes' sum as
the default budget. A row is repeated Poisson(rate) times: the distribution is inverted at a uniform number from the
md5 of seed and id. A rate above ``MOST_RATE`` is the sum of several Poisson numbers of equal smaller rates, each from
a hash of its own, which has the same distribution. Copies are then shuffled globally by the md5 of seed, id and copy.

The table of rates has a row per source and is stored first, so that Spark knows its size and sends it to all tasks if
it is small enough (its own limit), and joins by source otherwise; every other step is a projection, so a source with
a third of all rows is as cheap as any other.

Edge cases: a null source is a source of its own; rows with the same id draw the same number; null ids draw as the
empty id; an empty table gives an empty result; negative weights are an error, weight 0 drops a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MOST_RATE = 8.0
#: Steps of the inverted distribution: beyond 63 a rate of 8 has less than 2**-53 left.
STEPS = 63


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source_col: str, text_col: str, weights: dict[str | None, float] | None = None,
                 other: float = 1.0, budget: float | None = None) -> DataFrame:
    """(source, draws, cdf): how many Poisson numbers a row of the source draws, and their distribution."""
    if min([other, *(weights or {}).values()]) < 0:
        raise ValueError("a target weight is negative")
    sizes = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(
        F.sum(F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)) + 1).alias("size"))
    weight = F.lit(float(other))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    whole = F.lit(float(budget)) if budget is not None else weighed.agg(F.sum("size").cast("double")).scalar()
    all_weights = weighed.agg(F.sum("weight")).scalar()
    rates = weighed.select("source", (F.col("weight") / all_weights * whole / F.col("size")).alias("rate"))
    drawn = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("bigint"))
    mean = F.col("rate") / F.col("draws")
    steps = drawn.select("source", "draws", mean.alias("mean"), F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("k"))
    by = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    faculty = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0))).over(by)
    p = F.when(F.col("mean") > 0, F.exp(F.col("k") * F.log("mean") - F.col("mean") - F.col("faculty"))).otherwise(
        F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    cells = steps.withColumn("faculty", faculty).withColumn("p", p).withColumn("c", F.sum("p").over(by))
    return cells.groupBy("source", "draws").agg(F.array_sort(F.collect_list("c")).alias("cdf"))


def replicated(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
               weights: dict[str | None, float] | None = None, other: float = 1.0, budget: float | None = None,
               seed: str = "mix") -> DataFrame:
    """(row, copy, shuffle_key): all columns of ``docs`` as a struct, repeated and globally shuffled."""
    rates = materialize(source_rates(docs, source_col, text_col, weights, other, budget), "mixing-rates")
    key = F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    source = F.col(f"row.`{source_col}`")
    one = lambda j: F.size(F.filter("cdf", lambda c: c <= uniform(seed, key, j.cast("string"))))
    times = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("draws") - 1), F.lit(0),
                        lambda held, j: held + one(j))
    drawn = rows.join(rates, source.eqNullSafe(F.col("source"))).select("row", times.alias("times")).where("times > 0")
    copies = drawn.select("row", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    marked = copies.withColumn("shuffle_key", F.md5(F.concat_ws(
        "|", F.lit(seed), F.lit("shuffle"), key, F.col("copy").cast("string")).cast("binary")))
    return marked.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


#: The same in DuckDB for the default weights.
SQL = f"""
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0) + 1) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, 1.0::DOUBLE / (count(*) OVER ())::DOUBLE * (sum(size) OVER ())::DOUBLE / size::DOUBLE AS rate FROM sizes
), drawn AS (
  SELECT source, rate / greatest(1, ceil(rate / {MOST_RATE})) AS mean,
         greatest(1, ceil(rate / {MOST_RATE}))::BIGINT AS draws FROM rates
), cells AS (
  SELECT source, draws, k, exp(k * ln(mean) - mean - sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END)
         OVER (PARTITION BY source ORDER BY k)) AS p
  FROM drawn, (SELECT unnest(range({STEPS + 1})) AS k)
), cdf AS (
  SELECT source, draws, list(c ORDER BY k) AS cdf
  FROM (SELECT source, draws, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM cells) GROUP BY ALL
), times AS (
  SELECT d.doc_id, d.source, d.text, list_sum(list_transform(range(draws), lambda j: len(list_filter(cdf, lambda c: c <=
         ('0x' || substr(md5('mix|' || doc_id || '|' || j), 1, 13))::BIGINT / {1 << 52}::DOUBLE)))) AS times
  FROM documents d JOIN cdf USING (source)
)
SELECT doc_id, source, copy::INTEGER AS copy, md5('mix|shuffle|' || doc_id || '|' || copy) AS shuffle_key,
       md5(text) AS text_md5
FROM (SELECT *, unnest(range(times::BIGINT)) AS copy FROM times)
"""

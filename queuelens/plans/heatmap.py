"""Actor x diagnosis matrix of the top members, as volumes and as deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import signed_text, truncate_label
from ..operators.predicates import present
from ..operators.spread import distinct_per_group, spread
from ..session import scratch_dir
from ..sources.files import write_parquet

# Numbers of members per axis; the larger one also bounds what is broadcast.
MIN_MEMBERS, MAX_MEMBERS = 5, 100


def top_members(df: DataFrame, column: str, k: int, predicate: Column | None = None) -> DataFrame:
    """The ``k`` members (5 .. 100) with most distinct requests; ties in name order."""
    if not MIN_MEMBERS <= k <= MAX_MEMBERS:
        raise ValueError(f"k must lie within {MIN_MEMBERS} .. {MAX_MEMBERS}, not {k}")
    rows = df if predicate is None else df.filter(predicate)
    return (distinct_per_group(rows.filter(present(F.col(column))), "numeroCMCE", column)
            .orderBy(F.desc("Vol"), column).limit(k))


def cells(df: DataFrame, actor: str, diagnosis: str, top_actors: int = 15, top_diags: int = 15,
          predicate: Column | None = None) -> DataFrame:
    """Volume of every occurring pair of top members.

    The source is read once, down to its distinct (request, actor, diagnosis), which is stored
    in the work folder; both member lists and the cells come from there. The member lists
    have at most 100 rows, so broadcasting them is safe at any scale.
    """
    rows = df if predicate is None else df.filter(predicate)
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "heatmap")
    write_parquet(spread(rows.select("numeroCMCE", actor, diagnosis), "numeroCMCE", actor, diagnosis).distinct(), path)
    pairs = spark.read.parquet(path)
    actors = top_members(pairs, actor, top_actors).select(actor)
    diags = top_members(pairs, diagnosis, top_diags).select(diagnosis)
    return (pairs.join(F.broadcast(actors), actor, "left_semi")
            .join(F.broadcast(diags), diagnosis, "left_semi")
            .groupBy(F.col(actor).alias("ator"), F.col(diagnosis).alias("diag"))
            .agg(F.countDistinct("numeroCMCE").alias("Vol")))


def matrix(cells_df: DataFrame) -> DataFrame:
    """Dense matrix with 0 for pairs that do not occur.

    Diagnosis labels are cut to 45 characters; volumes of labels that become equal are
    averaged. The cells (at most 100 x 100, else an error) are folded into one row, which
    holds the axis members and a lookup map, and unfolded along both axes.
    """
    cut = (cells_df.withColumn("diag", truncate_label(F.col("diag")))
           .groupBy("diag", "ator").agg(F.avg("Vol").alias("Vol")))
    folded = cut.agg(
        F.collect_set("diag").alias("diags"), F.collect_set("ator").alias("atores"),
        F.map_from_entries(F.collect_list(F.struct(
            F.struct("diag", "ator").alias("k"), F.col("Vol").alias("v")))).alias("cell"))
    large = (F.size("diags") > MAX_MEMBERS) | (F.size("atores") > MAX_MEMBERS)
    diags = F.when(large, F.raise_error(F.lit("too many members for a matrix")).cast("array<string>")).otherwise(F.col("diags"))
    return (folded.select(F.explode(diags).alias("diag"), "atores", "cell")
            .select("diag", F.explode("atores").alias("ator"), "cell")
            .select("diag", "ator", F.coalesce(
                F.try_element_at("cell", F.struct("diag", "ator")), F.lit(0.0)).alias("Vol")))


def z_scores(matrix_df: DataFrame, by: str) -> DataFrame:
    """Deviation from the mean of the row (``by='diag'``) or of the column (``'ator'``).

    Sample deviation; a deviation of 0 divides by 1, a single member gives null.
    """
    over = Window.partitionBy(by)
    spread = F.stddev_samp("Vol").over(over)
    z = (F.col("Vol") - F.avg("Vol").over(over)) / F.when(spread == 0, 1.0).otherwise(spread)
    scored = matrix_df.withColumn("z", z)
    return scored.withColumn("z_text", signed_text(F.col("z")))

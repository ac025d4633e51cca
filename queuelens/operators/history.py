"""Ownership time, outcome and first events over an event table.

Input: one row per event with ``request``, ``ts`` (timestamp), ``seq`` (tie-break within
one instant), ``state`` and ``actor``. For documents that carry their whole history in one
row see ``plans.flatten``; both give the same figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import python_round
from ..states import MS_PER_DAY, REGULATOR, REQUESTER, is_final, new_owner, outcome_kind
from .prefixscan import in_pieces


OWNERS = {"REQUESTER": REQUESTER, "REGULATOR": REGULATOR}
#: Rows of one request that a task folds in one go.
BLOCK = 1_000_000


def _narrow(events: DataFrame) -> DataFrame:
    return events.select("request", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("ms"), "seq", "state", "actor")


def _folded(events: DataFrame, by: list[str], block: int) -> DataFrame:
    """One summary row per ``by`` key and piece; pieces follow each other like the events and have a bounded size."""
    cut = in_pieces(events, by, ["ms", "seq"], block)
    keys = [*by, "__piece"]
    order = Window.partitionBy(*keys).orderBy("ms", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    steps = (cut.withColumns({"mark": new_owner(F.col("state")), "final": is_final(F.col("state"))})
             .withColumns({"delta": F.col("ms") - F.lag("ms").over(order),
                           "owner": F.last("mark", ignorenulls=True).over(before),
                           "ended": F.coalesce(F.max("final").over(before), F.lit(False))})
             .filter(~F.col("ended")))
    delta, owner = F.coalesce(F.col("delta"), F.lit(0)), F.col("owner")

    def time_where(condition: Column) -> Column:
        return F.sum(F.when(condition, delta).otherwise(0))

    return steps.groupBy(*keys).agg(
        F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"),
        time_where(owner.isNull()).alias("inherited_ms"),
        time_where(owner == REQUESTER).alias("requester_ms"),
        time_where(owner == REGULATOR).alias("regulator_ms"),
        F.count_if(F.col("mark") == REGULATOR).alias("interactions"),
        F.max_by("mark", F.when(F.col("mark").isNotNull(), F.struct("ms", "seq"))).alias("last_mark"),
        F.max(F.when(F.col("final"), F.struct(F.col("ms"), F.col("state")))).alias("outcome"),
        F.bool_or(F.col("state") == "AUTORIZADA").alias("authorised"),
        F.bool_or(F.col("state") == "AGENDADA").alias("scheduled"),
        F.collect_set(F.nullif(F.col("actor"), F.lit(""))).alias("actors"),
        F.count(F.lit(1)).alias("n_events"))


def merged(summaries: DataFrame, by: list[str], order: str) -> DataFrame:
    """Summaries of consecutive stretches (numbered by ``order``) as one summary per ``by`` key.

    A summary holds first and last time, the time under each owner, the time before the first hand-over
    (``inherited_ms``, whose owner the stretches before decide), the last hand-over and the first final state. Merging
    is associative: stretches can be merged in any grouping that keeps their order.
    """
    place = Window.partitionBy(*by).orderBy(order)
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    linked = (summaries.withColumns({
        "carried": F.last("last_mark", ignorenulls=True).over(before),
        "gap_ms": F.coalesce(F.col("start_ms") - F.lag("end_ms").over(place), F.lit(0)),
        "ended": F.coalesce(F.max(F.col("outcome").isNotNull()).over(before), F.lit(False))})
        .filter(~F.col("ended")))
    handed = F.col("gap_ms") + F.col("inherited_ms")

    def time_of(owner: str) -> Column:
        return F.sum(F.col(f"{owner.lower()}_ms") + F.when(F.col("carried") == OWNERS[owner], handed).otherwise(0))

    return linked.groupBy(*by).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.sum(F.when(F.col("carried").isNull(), handed).otherwise(0)).alias("inherited_ms"),
        time_of("REQUESTER").alias("requester_ms"), time_of("REGULATOR").alias("regulator_ms"),
        F.sum("interactions").alias("interactions"),
        F.max_by("last_mark", F.when(F.col("last_mark").isNotNull(), F.col(order))).alias("last_mark"),
        F.max("outcome").alias("outcome"), F.bool_or("authorised").alias("authorised"),
        F.bool_or("scheduled").alias("scheduled"),
        F.array_distinct(F.flatten(F.collect_list("actors"))).alias("actors"), F.sum("n_events").alias("n_events"))


def segment_of(ms: Column, segment_days: float) -> Column:
    """Number of the stretch of time that an instant lies in."""
    return F.floor(ms / F.lit(max(1, int(segment_days * MS_PER_DAY)))).cast("bigint")


def with_segment(events: DataFrame, segment_days: float) -> DataFrame:
    return events.withColumn("segment", segment_of(F.coalesce(F.unix_millis("ts"), F.lit(0)), segment_days))


def segment_summaries(events: DataFrame, segment_days: float = 30, block: int = BLOCK) -> DataFrame:
    """One summary per (request, segment of time); ``merged`` over the segments gives the request's."""
    narrow = _narrow(events).withColumn("segment", segment_of(F.col("ms"), segment_days))
    keys = ["request", "segment"]
    return merged(_folded(narrow, keys, block), keys, "__piece")


def ownership(events: DataFrame, as_of, block: int = BLOCK) -> DataFrame:
    """Days per owner, outcome, milestones and actors, one row per request.

    Events after the first final state are ignored. Without a final state the time up to
    ``as_of`` goes to the present owner. A missing event time counts as epoch 0. Requests of more than ``block`` events
    are folded in pieces by rank, however their events lie in time; the figures do not depend on ``block``.
    """
    return ownership_figures(_folded(_narrow(events), ["request"], block), "__piece", as_of)


def ownership_figures(summaries: DataFrame, order: str, as_of) -> DataFrame:
    """Figures per request from the summaries of its stretches; a request belongs to the requester at first."""
    whole = merged(summaries, ["request"], order)
    total = whole.withColumns({"requester_ms": F.col("requester_ms") + F.col("inherited_ms"),
                               "owner": F.coalesce("last_mark", F.lit(REQUESTER)),
                               "actors": F.array_sort("actors")})
    now_ms = F.unix_millis(F.lit(str(as_of)).cast("timestamp"))
    return _figures(total, F.col("outcome"), now_ms)


def _figures(df: DataFrame, outcome: Column, now_ms: Column) -> DataFrame:
    open_ms = F.when(outcome.isNull(), now_ms - F.col("end_ms")).otherwise(0)
    requester = F.col("requester_ms") + F.when(F.col("owner") == REQUESTER, open_ms).otherwise(0)
    regulator = F.col("regulator_ms") + F.when(F.col("owner") == REGULATOR, open_ms).otherwise(0)

    def days(ms: Column) -> Column:
        return python_round(ms / F.lit(MS_PER_DAY), 2)

    kind = F.coalesce(outcome_kind(outcome["state"]), F.lit(""))
    return df.select(
        "request", days(requester).alias("SLA_Tempo_Solicitante_Dias"),
        days(regulator).alias("SLA_Tempo_Regulador_Dias"),
        days(requester + regulator).alias("SLA_Lead_Time_Total_Dias"),
        F.col("interactions").alias("SLA_Interacoes_Regulacao"),
        F.array_join("actors", " | ").alias("SLA_Atores_Envolvidos"),
        F.coalesce(outcome["ms"] != 0, F.lit(False)).alias("SLA_Desfecho_Atingido"),
        kind.alias("SLA_Tipo_Desfecho"),
        F.coalesce("authorised", F.lit(False)).alias("SLA_Marco_Autorizada"),
        F.coalesce("scheduled", F.lit(False)).alias("SLA_Marco_Agendada"),
        (kind == "POSITIVO").alias("SLA_Marco_Realizada"),
        F.col("owner").alias("posse_atual"), "n_events")


def first_event(events: DataFrame, *columns: str, where: Column | None = None) -> DataFrame:
    """Chosen columns of the earliest event per request, or of the earliest that meets
    ``where``. Requests without such an event keep a row with nulls."""
    return first_events(events, {"first": (columns, where)}).select("request", "first.*")


def first_events(events: DataFrame, wanted: dict[str, tuple[tuple, Column | None]]) -> DataFrame:
    """Several first events in one aggregation: result struct name -> (columns, condition)."""
    at = F.struct(F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("ms"), F.col("seq").alias("seq"))
    return events.groupBy("request").agg(*[
        F.min_by(F.struct(*columns), at if where is None else F.when(where, at)).alias(name)
        for name, (columns, where) in wanted.items()])

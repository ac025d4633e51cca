"""Ownership, outcome, first events and the running breaker over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract, dedup, history as h
from .views import AS_OF_EVENTS, HISTORY_DUCK, history, table

C = F.col

# sequential state fold as a recursive-free SQL: running last mark, previous time, ended flag
_STEPS = """s AS (SELECT *, CAST(epoch_ms(ts) AS BIGINT) AS ms,
  CASE WHEN state IN ('AGUARDA_REGULACAO','AGUARDA_REAVALIACAO','AGUARDA_REVERSAO','ENCAMINHADA_AO_NIR')
       THEN 'REGULADOR'
       WHEN state IN ('AUTORIZADA','AGENDADA','PENDENTE','AGUARDA_MATRICIAMENTO','AUTORIZACAO_AUTOMATICA',
         'CONFIRMACAO_EXPIRADA','AGENDA_CONFIRMADA') THEN 'SOLICITANTE' END AS mark,
  state IN ('REALIZADA','CANCELADA','CANCELADA_SEM_REVERSAO','ENCERRADA') AS fin FROM v),
t AS (SELECT *, COALESCE(LAST_VALUE(mark IGNORE NULLS) OVER w, 'SOLICITANTE') AS owner,
  COALESCE(ms - LAG(ms) OVER (PARTITION BY request ORDER BY ms, seq), 0) AS delta,
  COALESCE(bool_or(fin) OVER w, FALSE) AS ended FROM s
  WINDOW w AS (PARTITION BY request ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT * FROM t WHERE NOT ended),
g AS (SELECT request, SUM(CASE WHEN owner = 'SOLICITANTE' THEN delta ELSE 0 END) AS req,
  SUM(CASE WHEN owner = 'REGULADOR' THEN delta ELSE 0 END) AS reg, COUNT(*) FILTER (mark = 'REGULADOR') AS inter,
  arg_max(COALESCE(mark, owner), (ms, seq)) AS owner, MAX(ms) AS last_ms,
  MAX(CASE WHEN fin THEN state END) AS fin_state, bool_or(state = 'AUTORIZADA') AS auth,
  bool_or(state = 'AGENDADA') AS sched, array_to_string(list_sort(list_distinct(list(actor))), ' | ') AS actors,
  COUNT(*) AS n FROM k GROUP BY request),
f AS (SELECT *, CASE WHEN fin_state IS NULL THEN 1709251200000 - last_ms ELSE 0 END AS open_ms FROM g)"""


def _days(expr: str) -> str:
    return f"CAST(printf('%.2f', ({expr}) / 86400000.0::DOUBLE) AS DOUBLE)"


_REQ = "req + CASE WHEN owner = 'SOLICITANTE' THEN open_ms ELSE 0 END"
_REG = "reg + CASE WHEN owner = 'REGULADOR' THEN open_ms ELSE 0 END"
_KIND = """CASE WHEN fin_state IS NULL THEN '' WHEN fin_state = 'REALIZADA' THEN 'POSITIVO'
  WHEN fin_state = 'ENCERRADA' THEN 'ABANDONO' ELSE 'NEGATIVO' END"""


def ownership_days(spark, sf):
    """Days per owner and interactions."""
    return h.ownership(history(spark, sf), AS_OF_EVENTS).select(
        "request", "SLA_Tempo_Solicitante_Dias", "SLA_Tempo_Regulador_Dias", "SLA_Lead_Time_Total_Dias",
        "SLA_Interacoes_Regulacao", "SLA_Atores_Envolvidos")


OWNERSHIP_SQL = f"""WITH v AS ({HISTORY_DUCK}), {_STEPS}
SELECT request, {_days(_REQ)} AS "SLA_Tempo_Solicitante_Dias", {_days(_REG)} AS "SLA_Tempo_Regulador_Dias",
  {_days('req + reg + open_ms')} AS "SLA_Lead_Time_Total_Dias", inter AS "SLA_Interacoes_Regulacao",
  actors AS "SLA_Atores_Envolvidos" FROM f"""


def outcome_milestones(spark, sf):
    """M3: outcome and milestones; requests cut into small pieces by rank give the same figures."""
    return h.ownership(history(spark, sf), AS_OF_EVENTS, block=40).select(
        "request", "SLA_Desfecho_Atingido", "SLA_Tipo_Desfecho", "SLA_Marco_Autorizada", "SLA_Marco_Agendada",
        "SLA_Marco_Realizada", "n_events", "SLA_Tempo_Regulador_Dias")


OUTCOME_SQL = f"""WITH v AS ({HISTORY_DUCK}), {_STEPS}
SELECT request, fin_state IS NOT NULL AS "SLA_Desfecho_Atingido", {_KIND} AS "SLA_Tipo_Desfecho",
  auth AS "SLA_Marco_Autorizada", sched AS "SLA_Marco_Agendada",
  COALESCE(fin_state = 'REALIZADA', FALSE) AS "SLA_Marco_Realizada", n AS n_events,
  {_days(_REG)} AS "SLA_Tempo_Regulador_Dias" FROM f"""


def first_event(spark, sf):
    """First event and first event of a chosen kind."""
    chosen = (C("seq").alias("clinical_seq"), C("actor").alias("doctor"))
    both = h.first_events(history(spark, sf), {"first": (("seq", "state", "actor"), None),
                                               "clinical": (chosen, C("event_type") == "view")})
    return both.select("request", "first.*", "clinical.*")


FIRST_SQL = f"""WITH v AS ({HISTORY_DUCK})
SELECT request, arg_min(seq, (ts, seq)) AS seq, arg_min(state, (ts, seq)) AS state,
  arg_min(actor, (ts, seq)) AS actor, arg_min(seq, (ts, seq)) FILTER (event_type = 'view') AS clinical_seq,
  arg_min(actor, (ts, seq)) FILTER (event_type = 'view') AS doctor FROM v GROUP BY request"""


def sample_per_group(spark, sf):
    """Newest 500 events per type, helper column dropped."""
    e = table(spark, sf, "events")
    return dedup.top_per_group(e, "event_type", [F.desc_nulls_last("ts"), C("event_id")], 500).select(
        "event_type", "event_id", "value")


def running_breaker(spark, sf):
    """Running error ratio per event type, first opening and final counters."""
    e = table(spark, sf, "events").select(
        C("event_type").alias("run"), C("event_id").alias("seq"), (C("value") < 1.2).alias("failed"))
    return contract.breaker_verdict(contract.running_breaker(e, block=700))


BREAKER_SQL = """SELECT run, MIN(CASE WHEN failed AND total >= 100 AND errors / total > 0.05 THEN seq END) AS opened_at,
  MAX(total) AS total, CAST(MAX(errors) AS BIGINT) AS errors FROM (SELECT event_type AS run, event_id AS seq,
  value < 1.2 AS failed, COUNT(*) OVER w AS total, SUM(CAST(value < 1.2 AS INTEGER)) OVER w AS errors FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) GROUP BY run"""


QUERIES = {
    "ownership_days": (ownership_days, OWNERSHIP_SQL),
    "outcome_milestones": (outcome_milestones, OUTCOME_SQL),
    "first_event": (first_event, FIRST_SQL),
    "sample_per_group": (sample_per_group, """SELECT event_type, event_id, value FROM events
        QUALIFY ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS LAST, event_id) <= 500"""),
    "running_breaker": (running_breaker, BREAKER_SQL),
}

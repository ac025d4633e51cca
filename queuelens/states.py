"""States of a request and what they mean for ownership and outcome."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

REQUESTER, REGULATOR = "SOLICITANTE", "REGULADOR"

# States that hand the request to one side.
REGULATOR_STATES = ["AGUARDA_REGULACAO", "AGUARDA_REAVALIACAO", "AGUARDA_REVERSAO",
                    "ENCAMINHADA_AO_NIR"]
REQUESTER_STATES = ["AUTORIZADA", "AGENDADA", "PENDENTE", "AGUARDA_MATRICIAMENTO",
                    "AUTORIZACAO_AUTOMATICA", "CONFIRMACAO_EXPIRADA", "AGENDA_CONFIRMADA"]

# Final states by kind of outcome.
OUTCOMES = {"POSITIVO": ["REALIZADA"],
            "NEGATIVO": ["CANCELADA_SEM_REVERSAO", "CANCELADA"],
            "ABANDONO": ["ENCERRADA"]}
FINAL_STATES = [s for states in OUTCOMES.values() for s in states]

# Item labels (folded, lower case) that hold clinical text.
CLINICAL_LABELS = ["evolucao", "parecer", "comentarios", "descricao do quadro clinico",
                   "anamnese", "justificativa"]

MS_PER_DAY = 86400000.0


def new_owner(state: Column) -> Column:
    """Side that owns the request after this state; null where the state keeps the owner."""
    return F.when(state.isin(REGULATOR_STATES), REGULATOR).when(
        state.isin(REQUESTER_STATES), REQUESTER)


def is_final(state: Column) -> Column:
    return F.coalesce(state.isin(FINAL_STATES), F.lit(False))


def outcome_kind(state: Column) -> Column:
    kind = F.lit("")
    for name, states in OUTCOMES.items():
        kind = F.when(state.isin(states), name).otherwise(kind)
    return kind

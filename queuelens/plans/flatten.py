"""Request document (JSON text) to the wide flat row.

The whole mapping is a chain of projections: each document holds its own history, so no
shuffle is needed and a document never meets another one. Each parse result and each fold
is a column of its own, so it is worked out once per document however many result columns
read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fold_compat, sqltext as q
from ..schema import (DETAILS_DDL, DOCUMENT_DDL, BOOLEAN_COLUMNS, COUNT_COLUMNS, DATE_COLUMNS,
                      DAY_COLUMNS, POINT_COLUMNS, REQUEST_COLUMNS)
from ..states import (CLINICAL_LABELS, FINAL_STATES, MS_PER_DAY, OUTCOMES, REGULATOR,
                      REGULATOR_STATES, REQUESTER, REQUESTER_STATES)

CORRUPT = "_corrupt_record"
_JSON_OPTIONS = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
_SQL_OPTIONS = f"map('columnNameOfCorruptRecord', '{CORRUPT}', 'mode', 'PERMISSIVE')"

ITEMS_DDL = ("itensEvolucao ARRAY<STRUCT<codigo: STRING, label: STRING, texto: STRING>>, "
             f"{CORRUPT} STRING")
SNAPSHOT_DDL = f"{DETAILS_DDL}, {CORRUPT} STRING"


# --- parsing ----------------------------------------------------------------------------

def parse_document(text: Column, ddl: str = DOCUMENT_DDL) -> Column:
    """Typed struct of a document; ``_corrupt_record`` is set where the text is no document."""
    return F.from_json(text, f"{ddl}, {CORRUPT} STRING", _JSON_OPTIONS)


def parse_details(x: str, ddl: str = ITEMS_DDL) -> str:
    """JSON inside JSON as a struct; null for a text that does not start an object.

    Broken JSON sets ``_corrupt_record``; readers go through ``intact``.
    """
    return f"from_json(CASE WHEN startswith(ltrim('{q.BLANKS}', {x}), '{{') THEN {x} END, '{ddl}', {_SQL_OPTIONS})"


def intact(parsed: str, field: str) -> str:
    """A field of parsed details, null where the text was broken."""
    return f"CASE WHEN {parsed}.{CORRUPT} IS NULL THEN {parsed}.{field} END"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sorted_events(events: str) -> str:
    """Events in time order; missing time is 0, ties keep their place."""
    return f"""transform(array_sort(transform(coalesce({events}, array()), (e, i) -> struct(
        coalesce({q.epoch_ms('e.data')}, 0L) AS ms, i AS pos, e AS e))), k -> struct(k.ms AS ms, k.e AS e))"""


def parsed_events(events: str) -> str:
    """Add the parsed details to sorted events."""
    return f"transform({events}, k -> struct(k.ms AS ms, k.e AS e, {parse_details('k.e.detalhes')} AS det))"


def item_texts(det: str) -> str:
    """Label and stripped text of the non-empty items of parsed details."""
    return f"""filter(transform(coalesce({intact(det, 'itensEvolucao')}, array()), i -> struct(
        coalesce(i.label, i.codigo, 'Informação') AS label, {q.strip(q.blank('i.texto'))} AS texto)),
        t -> t.texto <> '')"""


def until_final(events: str) -> str:
    """Sorted events up to and including the first final state."""
    end = f"array_position(transform({events}, k -> coalesce(k.e.situacaoAtual, '') IN ({q.quoted(FINAL_STATES)})), TRUE)"
    return f"slice({events}, 1, CAST(coalesce(nullif({end}, 0L), size({events})) AS INT))"


# Times, names and items of the cut events are columns of their own: a result that reads no items parses no details.

def event_times(events: str) -> str:
    """Display time and user of each event."""
    return f"""transform({events}, k -> struct({q.ms_text('k.ms')} AS when, coalesce(k.e.usuario.nome, 'Sistema') AS user))"""


def event_items(events: str) -> str:
    """Label and text of the items of each event."""
    return f"transform({events}, k -> {_let('det', parse_details('k.e.detalhes'), item_texts('det'))})"


# --- folds over the events of one document ----------------------------------------------

def ownership_of(events: str) -> str:
    """Time per owner, interactions and present owner of events cut at the final state."""
    state = "e.e.situacaoAtual"
    mark = (f"CASE WHEN {state} IN ({q.quoted(REGULATOR_STATES)}) THEN '{REGULATOR}' "
            f"WHEN {state} IN ({q.quoted(REQUESTER_STATES)}) THEN '{REQUESTER}' END")
    delta = "coalesce(e.ms - a.last_ms, 0L)"
    return f"""aggregate({events},
        struct(0L AS requester_ms, 0L AS regulator_ms, 0L AS interactions, '{REQUESTER}' AS owner,
               CAST(NULL AS BIGINT) AS last_ms),
        (a, e) -> struct(
            a.requester_ms + if(a.owner = '{REQUESTER}', {delta}, 0L) AS requester_ms,
            a.regulator_ms + if(a.owner = '{REGULATOR}', {delta}, 0L) AS regulator_ms,
            a.interactions + if({state} IN ({q.quoted(REGULATOR_STATES)}), 1L, 0L) AS interactions,
            coalesce({mark}, a.owner) AS owner, e.ms AS last_ms))"""


def is_clinical(item: Column) -> Column:
    label = F.lower(item["label"])
    return label.isin(CLINICAL_LABELS) | fold_compat(label).isin(CLINICAL_LABELS)


def clinical_events(times: Column, items: Column) -> Column:
    """Events that have clinical items, with only those items."""
    picked = F.transform(times, lambda e, n: F.struct(
        e["when"].alias("when"), e["user"].alias("user"),
        F.filter(F.get(items, n), is_clinical).alias("items")))
    return F.filter(picked, lambda e: F.size(e["items"]) > 0)


def clinical_fold(clinical: str) -> str:
    """'[date | user]: text' of every clinical item, joined by ' || '."""
    return f"""array_join(flatten(transform({clinical}, e -> transform(e.items, i ->
        concat('[', e.when, ' | ', e.user, ']: ', i.texto)))), ' || ')"""


def full_fold(events: str, times: str, items: str) -> str:
    """'[date | user] -> op (a ➔ b) | label: text ...' per event, joined by ' || '."""
    return f"""array_join(transform({events}, (k, n) -> concat(
        '[', {times}[n].when, ' | ', {times}[n].user, '] -> ', {q.blank('k.e.operacaoSolicitacao')}, ' (',
        {q.blank('k.e.situacaoAnterior')}, ' ➔ ', {q.blank('k.e.situacaoAtual')}, ')',
        array_join(transform({items}[n], i -> concat(' | ', i.label, ': ', i.texto)), ''))), ' || ')"""


def actors_joined(events: str) -> str:
    return (f"array_join(array_sort(array_distinct(filter(transform({events}, k -> k.e.usuario.nome), "
            "n -> n <> ''))), ' | ')")


def events_json(events: str, times: str, items: str) -> str:
    """Compact JSON text of the cleaned events."""
    return f"""to_json(transform({events}, (k, n) -> struct(
        {times}[n].when AS data, {times}[n].user AS usuario_nome, {q.blank('k.e.usuario.cpf')} AS usuario_cpf,
        {q.blank('k.e.perfil')} AS perfil, {q.blank('k.e.operacaoSolicitacao')} AS operacaoSolicitacao,
        {q.blank('k.e.situacaoAnterior')} AS situacaoAnterior, {q.blank('k.e.situacaoAtual')} AS situacaoAtual,
        {items}[n] AS detalhes_limpos)))"""


# --- columns ----------------------------------------------------------------------------

def unit_block(unit: str, prefix: str) -> dict[str, str]:
    """Five columns of an organisational unit."""
    paths = ["nome", "razaoSocial", "tipoUnidade.descricao", "municipio.nome", "municipio.uf"]
    return {f"{prefix}_{p.replace('.', '_')}": q.blank(f"{unit}.{p}") for p in paths}


def _root_columns() -> dict[str, str]:
    u, salt = "d.usuarioSUS", "__salt"

    def texts(base: str, prefix: str, fields: list[str]) -> dict[str, str]:
        return {f"{prefix}{f.replace('.', '_')}": q.blank(f"{base}.{f}") for f in fields}

    columns = texts("d", "", [
        "numeroCMCE", "situacao", "corRegulador", "liminarOrdemJudicial", "regularizacaoAcesso",
        "statusProvisorio", "justificativaRetorno", "justificativaDuplicacao", "motivoPendencia",
        "motivoCancelamento", "motivoEncerramento", "descricaoEncerramento"])
    columns |= texts(u, "usuarioSUS_", [
        "sexo", "racaCor", "nacionalidade", "logradouro", "numero", "complemento", "bairro", "cep",
        "municipioResidencia.nome", "municipioResidencia.uf"])
    columns |= {f"usuarioSUS_{f}": q.hash_identity(f"{u}.{f}", salt)
                for f in ["nomeCompleto", "cpf", "nomeMae", "cartaoSus"]}
    columns |= {f: q.epoch_text(f"d.{f}")
                for f in ["dataSolicitacao", "dataPrimeiroAgendamento", "dataPrimeiraAutorizacao"]}
    columns["usuarioSUS_dataNascimento"] = q.epoch_text(f"{u}.dataNascimento", "dd/MM/yyyy")
    columns["origem_lista"] = "__list"
    for who in ["operador", "usuarioSolicitante"]:
        columns[f"{who}_nome"] = q.first_filled(f"d.{who}.nome", f"d.{who}.profissional.nome")
        columns[f"{who}_cpf"] = q.hash_identity(
            q.first_filled(f"d.{who}.cpf", f"d.{who}.profissional.cpf"), salt)
    return columns


def _snapshot_columns() -> dict[str, str]:
    """Columns of the first event's snapshot; all '' or false where there is none."""
    texts = ["sistemaOrigem", "complexidade", "cidPrincipal.codigo", "cidPrincipal.descricao",
             "especialidade.descricao", "especialidade.descricaoAuxiliar",
             "especialidade.cbo.descricao", "especialidade.especialidadeMae.descricao",
             "especialidade.especialidadeMae.cbo.descricao", "especialidade.tipoRegulacao",
             "classificacaoRisco.cor", "municipioUsuarioSUS.nome", "municipioUsuarioSUS.uf"]
    flags = ["semClassificacao", "foraDaRegionalizacao", "possuiDita", "especialidade.teleconsulta",
             "especialidade.ativa", "especialidade.matriciamento", "especialidade.tipoOCI",
             "classificacaoRisco.reclassificadaSolicitante"]
    columns = {f"entidade_{p.replace('.', '_')}": q.blank(f"x.{p}") for p in texts}
    columns |= {f"entidade_{p.replace('.', '_')}": q.truthy_variant(f"x.{p}") for p in flags}
    columns |= {f"entidade_classificacaoRisco_{p}":
                f"CASE WHEN x IS NOT NULL THEN coalesce(x.classificacaoRisco.{p}, '0') ELSE '' END"
                for p in ["totalPontos", "pontosGravidade", "pontosTempo"]}
    for unit in ["unidadeOperador", "unidadeReferencia"]:
        columns |= unit_block(f"x.{unit}", f"entidade_{unit}")
        columns |= unit_block(f"x.{unit}.centralRegulacao", f"entidade_{unit}_centralRegulacao")
    return columns | unit_block("x.centralRegulacao", "entidade_centralRegulacao")


def _history_columns() -> dict[str, str]:
    """Columns read from the cut events ``ev``, their ``times`` and ``items`` and the folds ``own`` and ``clinical``.

    An empty history leaves the fold's start value, whose last time is null.
    """
    last = "try_element_at(ev, -1).e.situacaoAtual"
    ended = f"coalesce({last} IN ({q.quoted(FINAL_STATES)}), FALSE)"
    kind = "CASE " + " ".join(f"WHEN {last} IN ({q.quoted(states)}) THEN '{name}'"
                              for name, states in OUTCOMES.items()) + " ELSE '' END"
    still_open = f"if({ended}, 0L, coalesce(__now - own.last_ms, 0L))"
    requester = f"(own.requester_ms + if(own.owner = '{REQUESTER}', {still_open}, 0L))"
    regulator = f"(own.regulator_ms + if(own.owner <> '{REQUESTER}', {still_open}, 0L))"

    def days(ms: str) -> str:
        return q.python_round(f"{ms} / {MS_PER_DAY}D", 2)

    def reached(state: str) -> str:
        return f"exists(ev, k -> coalesce(k.e.situacaoAtual, '') = '{state}')"

    return {
        "SLA_Tempo_Solicitante_Dias": days(requester), "SLA_Tempo_Regulador_Dias": days(regulator),
        "SLA_Lead_Time_Total_Dias": days(f"({requester} + {regulator})"),
        "SLA_Interacoes_Regulacao": "own.interactions",
        "SLA_Atores_Envolvidos": actors_joined("ev"),
        "SLA_Desfecho_Atingido": f"{ended} AND coalesce(own.last_ms, 0L) <> 0",
        "SLA_Tipo_Desfecho": kind, "SLA_Marco_Autorizada": reached("AUTORIZADA"),
        "SLA_Marco_Agendada": reached("AGENDADA"), "SLA_Marco_Realizada": f"{kind} = 'POSITIVO'",
        "dataCadastro": q.blank("get(clinical, 0).when"),
        "medicoSolicitante": q.blank("get(clinical, 0).user"),
        "historico_quadro_clinico": clinical_fold("clinical"),
        "historico_evolucoes_completo": full_fold("ev", "times", "items"),
        "evolucoes_json": events_json("ev", "times", "items"),
    }


def flatten(raw: DataFrame, as_of, salt: str, text: str = "conteudo_json",
            list_name: str = "origem_lista", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat rows in canonical column order; ``keep`` passes further raw columns through."""
    now_ms = F.unix_millis(F.lit(str(as_of)).cast("timestamp"))
    staged = (
        raw.select(*keep, F.col(list_name).alias("__list"), parse_document(F.col(text)).alias("d"))
        .selectExpr("*", f"{sorted_events('d.evolucoes')} AS sorted")
        .selectExpr("*", f"{parse_details('get(sorted, 0).e.detalhes', SNAPSHOT_DDL)} AS first",
                    f"{until_final('sorted')} AS ev")
        .selectExpr("*", f"{intact('first', 'entidade')} AS x", f"{event_times('ev')} AS times",
                    f"{event_items('ev')} AS items", f"{ownership_of('ev')} AS own")
        .withColumns({"clinical": clinical_events(F.col("times"), F.col("items")),
                      "__salt": F.lit(salt), "__now": now_ms}))
    columns = _root_columns() | _snapshot_columns() | _history_columns()
    return staged.selectExpr(*keep, *[f"{columns[c]} AS {c}" for c in REQUEST_COLUMNS])


def canonical(df: DataFrame, columns: list[str] = REQUEST_COLUMNS,
              breaks: Callable[[str], str] = q.normalise_breaks) -> DataFrame:
    """Fixed column order; absent columns become '', line breaks in texts are removed."""
    types = dict(df.dtypes)

    def cell(name: str) -> str:
        if name not in types:
            return f"'' AS `{name}`"
        c = f"`{name}`"
        return f"{q.blank(breaks(c))} AS {c}" if types[name] == "string" else c

    return df.selectExpr(*[cell(c) for c in columns])


def typed(flat: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical flat rows with their stored types (dates, flags, days, counts, text);
    ``keep`` passes further columns through."""
    def convert(name: str) -> str:
        text = f"CAST({name} AS STRING)"
        if name in DATE_COLUMNS:
            fmt = "dd/MM/yyyy" if name == "usuarioSUS_dataNascimento" else "dd/MM/yyyy HH:mm:ss"
            return f"try_to_timestamp({text}, '{fmt}')"
        if name in BOOLEAN_COLUMNS:
            # any non-empty text counts as true
            return f"coalesce({text} NOT IN ('', 'false'), FALSE)"
        if name in POINT_COLUMNS:
            return f"try_cast({text} AS DOUBLE)"
        if name in DAY_COLUMNS:
            return f"coalesce(try_cast({text} AS DOUBLE), 0D)"
        if name in COUNT_COLUMNS:
            return f"coalesce(try_cast({text} AS BIGINT), 0L)"
        return f"CASE WHEN {text} IN ('None', 'nan', '<NA>') THEN '' ELSE coalesce({text}, '') END"
    return flat.selectExpr(*[f"{convert(c)} AS {c}" for c in REQUEST_COLUMNS], *keep)

"""The two retired flat layouts (32 and 16 headings) and the text-history exploder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import day_first_timestamp, key_value_lines, regex_group, sqltext as q, strip
from ..functions.dates import DAY_FORMAT, MINUTE_FORMAT
from .flatten import intact, item_texts, parse_document, parsed_events, sorted_events

# Headings of the 32-column layout.
COLUMNS_32 = [
    "Protocolo", "Especialidade Mãe", "Especialidade", "Especialidade Descrição",
    "Especialista", "CID Código", "CID Principal", "Situação da Solicitação",
    "Data da Solicitação", "Data do Primeiro Agendamento", "Pontuação", "Pontuação Cor",
    "Complexidade", "Cor do Regulador", "Unidade Solicitante", "Médico Solicitante",
    "Médico Solicitante Email", "Quadro Clínico", "Nome do Paciente", "Data de Nascimento",
    "Sexo", "Cor", "CPF", "Nome da Mãe", "Cartão SUS", "Logradouro", "Número",
    "Complemento", "Bairro", "CEP", "Nacionalidade", "Ordem Judicial",
]

# Headings of the 16-column layout.
COLUMNS_16 = [
    "Protocolo", "Situação", "Origem da Lista", "Data Solicitação", "Data Nascimento",
    "Paciente", "CPF", "CNS", "Especialidade", "Complexidade", "Risco Cor", "Pontuação",
    "CID Código", "CID Descrição", "Unidade Solicitante", "Histórico Quadro Clínico",
]

# Split and item form of the text history.
HISTORY_COLUMN = "Histórico Quadro Clínico"
HISTORY_SPLIT = r"\s*\|\s*(?=\n\n\[)"
HISTORY_ITEM = r"(?s)\[(.*?)\s*\|\s*(.*?)\s*\|\s*(.*?)\]:\s*(.*)"
HISTORY_FIELDS = ["Data_Evolucao", "Tipo_Informacao", "Origem_Informacao", "Texto_Evolucao"]


# Fields that the retired layouts read of a document; the others are skipped by the parser.
LEGACY_DDL = (
    "numeroCMCE STRING, situacao STRING, corRegulador STRING, dataSolicitacao STRING, dataPrimeiroAgendamento STRING, "
    "liminarOrdemJudicial STRING, complexidade STRING, usuarioSUS STRUCT<nomeCompleto: STRING, dataNascimento: STRING, "
    "cpf: STRING, cartaoSus: STRING, nomeMae: STRING, sexo: STRING, racaCor: STRING, nacionalidade: STRING, "
    "logradouro: STRING, numero: STRING, complemento: STRING, bairro: STRING, cep: STRING>, "
    "usuarioSolicitante STRUCT<nome: STRING, email: STRING>, especialidade STRUCT<descricao: STRING, "
    "descricaoAuxiliar: STRING, especialidadeMae: STRUCT<descricao: STRING, cbo: STRUCT<descricao: STRING>>>, "
    "cidPrincipal STRUCT<codigo: STRING, descricao: STRING>, classificacaoRisco STRUCT<totalPontos: STRING, cor: STRING>, "
    "unidadeSolicitante STRUCT<nome: STRING>, "
    "evolucoes ARRAY<STRUCT<data: STRING, usuario: STRUCT<nome: STRING>, detalhes: STRING>>")


def parsed_documents(raw: DataFrame, text: str = "conteudo_json") -> DataFrame:
    """Add the document struct ``d`` (the fields of these layouts) and its parsed ``events``, one stage per parse."""
    return (raw.withColumn("d", parse_document(F.col(text), LEGACY_DDL))
            .selectExpr("*", f"{sorted_events('d.evolucoes')} AS __sorted")
            .selectExpr("*", f"{parsed_events('__sorted')} AS events").drop("__sorted"))


def all_items(events: str = "events") -> str:
    """Items of all parsed events in time order, flattened into one list."""
    return f"flatten(transform({events}, k -> coalesce({intact('k.det', 'itensEvolucao')}, array())))"


def by_code_last(items: str, code: str) -> str:
    """Text of the last item with this code; null where there is none."""
    return f"try_element_at(filter({items}, i -> i.codigo = '{code}'), -1).texto"


def regional_values(items: str) -> Column:
    """'key: value' lines of the regional item as map entries 'Regionalização <key>'."""
    lines = F.expr(q.blank(by_code_last(items, "regionalizacao")))
    return F.transform_keys(key_value_lines(lines), lambda k, _: F.concat(F.lit("Regionalização "), k))


def flat_32(raw: DataFrame, text: str = "conteudo_json", keep: tuple[str, ...] = ()) -> DataFrame:
    staged = parsed_documents(raw, text).selectExpr("*", f"{all_items()} AS items")
    spec, user, doctor = "d.especialidade", "d.usuarioSUS", "d.usuarioSolicitante"
    values = [
        q.format_key("d.numeroCMCE"), f"{spec}.especialidadeMae.descricao", f"{spec}.descricao",
        f"{spec}.descricaoAuxiliar", f"{spec}.especialidadeMae.cbo.descricao",
        "d.cidPrincipal.codigo", "d.cidPrincipal.descricao", "d.situacao",
        q.epoch_text("d.dataSolicitacao"), q.epoch_text("d.dataPrimeiroAgendamento"),
        "d.classificacaoRisco.totalPontos", "d.classificacaoRisco.cor", "d.complexidade",
        "d.corRegulador", "d.unidadeSolicitante.nome", f"{doctor}.nome", f"{doctor}.email",
        by_code_last("items", "anamnese"), f"{user}.nomeCompleto",
        q.epoch_text(f"{user}.dataNascimento", DAY_FORMAT),
        *[f"{user}.{f}" for f in ["sexo", "racaCor", "cpf", "nomeMae", "cartaoSus", "logradouro",
                                  "numero", "complemento", "bairro", "cep", "nacionalidade"]],
        "d.liminarOrdemJudicial"]
    return staged.selectExpr(*keep, *[f"{q.unify_breaks(q.blank(v))} AS `{name}`"
                                      for name, v in zip(COLUMNS_32, values, strict=True)])


def history_fold(events: str = "events") -> str:
    """'[date - label - user]: text' of every non-empty item, joined by ' | '."""
    return f"""array_join(flatten(transform({events}, k -> transform({item_texts('k.det')}, i ->
        concat('[', {q.ms_text('k.ms', MINUTE_FORMAT)}, ' - ', i.label, ' - ',
               coalesce(k.e.usuario.nome, 'Sistema'), ']: ', i.texto)))), ' | ')"""


def flat_16(raw: DataFrame, text: str = "conteudo_json", list_name: str = "origem_lista",
            keep: tuple[str, ...] = ()) -> DataFrame:
    user, risk = "d.usuarioSUS", "d.classificacaoRisco"
    values = [
        q.format_key("d.numeroCMCE"), "d.situacao", list_name,
        q.epoch_text("d.dataSolicitacao", MINUTE_FORMAT),
        q.epoch_text(f"{user}.dataNascimento", DAY_FORMAT), f"{user}.nomeCompleto", f"{user}.cpf",
        f"{user}.cartaoSus", "d.especialidade.descricao", "d.complexidade", f"{risk}.cor",
        f"{risk}.totalPontos", "d.cidPrincipal.codigo", "d.cidPrincipal.descricao",
        "d.unidadeSolicitante.nome", history_fold()]
    return parsed_documents(raw, text).selectExpr(
        *keep, *[f"{q.blank(v)} AS `{name}`" for name, v in zip(COLUMNS_16, values, strict=True)])


def explode_history(df: DataFrame, column: str = HISTORY_COLUMN) -> DataFrame:
    """One row per item of the text history, with date, kind, origin and text columns.

    A frame without the column comes back unchanged; rows with null history stay.
    """
    if column not in df.columns:
        return df
    item = F.col("__item")
    parts = {name: regex_group(item, HISTORY_ITEM, i + 1) for i, name in enumerate(HISTORY_FIELDS)}
    parts["Data_Evolucao"] = day_first_timestamp(parts["Data_Evolucao"])
    return (df.withColumn("__item", F.explode_outer(F.split(F.col(column), HISTORY_SPLIT)))
            .withColumn("__item", strip(item)).withColumns(parts).drop("__item", column))

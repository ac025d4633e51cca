"""Column names and types of the request table and of the raw documents."""

from __future__ import annotations

from pyspark.sql import types as T

# The canonical column order of the flat request table.
REQUEST_COLUMNS = [
    "numeroCMCE", "situacao", "origem_lista", "corRegulador", "dataSolicitacao",
    "liminarOrdemJudicial",
    "usuarioSUS_nomeCompleto", "usuarioSUS_dataNascimento", "usuarioSUS_sexo",
    "usuarioSUS_racaCor", "usuarioSUS_cpf", "usuarioSUS_nomeMae", "usuarioSUS_cartaoSus",
    "usuarioSUS_nacionalidade", "usuarioSUS_logradouro", "usuarioSUS_numero",
    "usuarioSUS_complemento", "usuarioSUS_bairro", "usuarioSUS_cep",
    "usuarioSUS_municipioResidencia_nome", "usuarioSUS_municipioResidencia_uf",
    "operador_nome", "operador_cpf", "usuarioSolicitante_nome", "usuarioSolicitante_cpf",
    "dataPrimeiroAgendamento", "dataPrimeiraAutorizacao", "regularizacaoAcesso",
    "statusProvisorio", "justificativaRetorno", "justificativaDuplicacao",
    "motivoPendencia", "motivoCancelamento", "motivoEncerramento", "descricaoEncerramento",
    "entidade_sistemaOrigem", "entidade_complexidade", "entidade_semClassificacao",
    "entidade_cidPrincipal_codigo", "entidade_cidPrincipal_descricao",
    "entidade_especialidade_descricao", "entidade_especialidade_descricaoAuxiliar",
    "entidade_especialidade_cbo_descricao",
    "entidade_especialidade_especialidadeMae_descricao",
    "entidade_especialidade_especialidadeMae_cbo_descricao",
    "entidade_especialidade_tipoRegulacao", "entidade_especialidade_teleconsulta",
    "entidade_especialidade_ativa", "entidade_especialidade_matriciamento",
    "entidade_especialidade_tipoOCI",
    "entidade_classificacaoRisco_totalPontos", "entidade_classificacaoRisco_pontosGravidade",
    "entidade_classificacaoRisco_pontosTempo", "entidade_classificacaoRisco_cor",
    "entidade_classificacaoRisco_reclassificadaSolicitante",
    "entidade_foraDaRegionalizacao", "entidade_possuiDita",
    "entidade_municipioUsuarioSUS_nome", "entidade_municipioUsuarioSUS_uf",
    "entidade_unidadeOperador_nome", "entidade_unidadeOperador_razaoSocial",
    "entidade_unidadeOperador_tipoUnidade_descricao",
    "entidade_unidadeOperador_municipio_nome", "entidade_unidadeOperador_municipio_uf",
    "entidade_unidadeOperador_centralRegulacao_nome",
    "entidade_unidadeOperador_centralRegulacao_razaoSocial",
    "entidade_unidadeOperador_centralRegulacao_tipoUnidade_descricao",
    "entidade_unidadeOperador_centralRegulacao_municipio_nome",
    "entidade_unidadeOperador_centralRegulacao_municipio_uf",
    "entidade_unidadeReferencia_nome", "entidade_unidadeReferencia_razaoSocial",
    "entidade_unidadeReferencia_tipoUnidade_descricao",
    "entidade_unidadeReferencia_municipio_nome", "entidade_unidadeReferencia_municipio_uf",
    "entidade_unidadeReferencia_centralRegulacao_nome",
    "entidade_unidadeReferencia_centralRegulacao_razaoSocial",
    "entidade_unidadeReferencia_centralRegulacao_tipoUnidade_descricao",
    "entidade_unidadeReferencia_centralRegulacao_municipio_nome",
    "entidade_unidadeReferencia_centralRegulacao_municipio_uf",
    "entidade_centralRegulacao_nome", "entidade_centralRegulacao_razaoSocial",
    "entidade_centralRegulacao_tipoUnidade_descricao",
    "entidade_centralRegulacao_municipio_nome", "entidade_centralRegulacao_municipio_uf",
    "SLA_Tempo_Solicitante_Dias", "SLA_Tempo_Regulador_Dias", "SLA_Lead_Time_Total_Dias",
    "SLA_Interacoes_Regulacao", "SLA_Atores_Envolvidos", "SLA_Desfecho_Atingido",
    "SLA_Tipo_Desfecho", "SLA_Marco_Autorizada", "SLA_Marco_Agendada",
    "SLA_Marco_Realizada",
    "dataCadastro", "medicoSolicitante",
    "historico_quadro_clinico", "historico_evolucoes_completo", "evolucoes_json",
]

# Columns by type of the consolidated table.
DATE_COLUMNS = ["dataSolicitacao", "usuarioSUS_dataNascimento", "dataCadastro",
                "dataPrimeiroAgendamento", "dataPrimeiraAutorizacao"]
BOOLEAN_COLUMNS = [
    "regularizacaoAcesso", "entidade_semClassificacao",
    "entidade_especialidade_teleconsulta", "entidade_especialidade_ativa",
    "entidade_especialidade_matriciamento", "entidade_especialidade_tipoOCI",
    "entidade_classificacaoRisco_reclassificadaSolicitante",
    "entidade_foraDaRegionalizacao", "entidade_possuiDita",
    "SLA_Desfecho_Atingido", "SLA_Marco_Autorizada", "SLA_Marco_Agendada",
    "SLA_Marco_Realizada",
]
DAY_COLUMNS = ["SLA_Tempo_Solicitante_Dias", "SLA_Tempo_Regulador_Dias",
               "SLA_Lead_Time_Total_Dias"]
POINT_COLUMNS = ["entidade_classificacaoRisco_totalPontos",
                 "entidade_classificacaoRisco_pontosGravidade",
                 "entidade_classificacaoRisco_pontosTempo"]
COUNT_COLUMNS = ["SLA_Interacoes_Regulacao"]

# Contract of the analytic view, and headings of the retired layout.
REQUIRED_COLUMNS = ["numeroCMCE", "entidade_classificacaoRisco_cor",
                    "entidade_especialidade_descricao", "dataSolicitacao", "dataCadastro"]
LEGACY_COLUMNS = ["Protocolo", "Risco Cor", "Município de Residência",
                  "Médico Solicitante", "Situação Final"]

# Direct identifiers hashed by the batch job.
DIRECT_IDENTIFIERS = ["usuarioSUS_nomeCompleto", "usuarioSUS_cpf", "usuarioSUS_cartaoSus",
                      "usuarioSUS_nomeMae", "usuarioSUS_telefones", "operador_cpf",
                      "usuarioSolicitante_cpf"]

# Columns read as text whatever they look like.
TEXT_LOAD_COLUMNS = ["numeroCMCE", "situacao", "corRegulador", "entidade_complexidade",
                     "entidade_classificacaoRisco_cor", "usuarioSUS_cartaoSus",
                     "usuarioSUS_cpf", "usuarioSUS_cep",
                     "entidade_especialidade_teleconsulta"]
TEXT_EXPORT_COLUMNS = ["usuarioSUS_numero", "usuarioSUS_complemento", "usuarioSUS_cep",
                       "entidade_cidPrincipal_codigo", "entidade_cidPrincipal_descricao"]


def request_type(column: str) -> T.DataType:
    """Stored type of one column of the consolidated request table."""
    if column in DATE_COLUMNS:
        return T.TimestampType()
    if column in BOOLEAN_COLUMNS:
        return T.BooleanType()
    if column in DAY_COLUMNS + POINT_COLUMNS:
        return T.DoubleType()
    if column in COUNT_COLUMNS:
        return T.LongType()
    return T.StringType()


REQUEST_SCHEMA = T.StructType([T.StructField(c, request_type(c)) for c in REQUEST_COLUMNS])

# Raw store: one row per captured version of a document.
RAW_SCHEMA = T.StructType([
    T.StructField("protocolo", T.StringType()),
    T.StructField("data_captura", T.TimestampType()),
    T.StructField("data_alteracao", T.LongType()),
    T.StructField("conteudo_json", T.StringType()),
    T.StructField("origem_lista", T.StringType()),
])

# Audit row of one ingest run.
RUN_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("items_ingested", T.LongType()),
    T.StructField("items_failed", T.LongType()),
    T.StructField("bytes_processed", T.LongType()),
    T.StructField("target_lists", T.ArrayType(T.StringType())),
    T.StructField("error_message", T.StringType()),
])

_UNIT_FIELDS = ("nome: STRING, razaoSocial: STRING, tipoUnidade: STRUCT<descricao: STRING>, "
                "municipio: STRUCT<nome: STRING, uf: STRING>")
_UNIT_WITH_CENTRE = (f"STRUCT<{_UNIT_FIELDS}, centralRegulacao: STRUCT<{_UNIT_FIELDS}>>")
_ACTOR = ("STRUCT<nome: STRING, cpf: STRING, email: STRING, "
          "profissional: STRUCT<nome: STRING, cpf: STRING>>")
_SPECIALTY = (
    "STRUCT<descricao: STRING, descricaoAuxiliar: STRING, cbo: STRUCT<descricao: STRING>, "
    "especialidadeMae: STRUCT<descricao: STRING, cbo: STRUCT<descricao: STRING>>, "
    "tipoRegulacao: STRING, teleconsulta: VARIANT, ativa: VARIANT, "
    "matriciamento: VARIANT, tipoOCI: VARIANT>")
_RISK = ("STRUCT<totalPontos: STRING, pontosGravidade: STRING, pontosTempo: STRING, "
         "cor: STRING, reclassificadaSolicitante: VARIANT>")

# The request document; unknown keys are ignored by the parser.
DOCUMENT_DDL = (
    "numeroCMCE STRING, situacao STRING, corRegulador STRING, dataSolicitacao STRING, "
    "dataCadastro STRING, dataAlterouUltimaSituacao STRING, liminarOrdemJudicial STRING, "
    "complexidade STRING, "
    "usuarioSUS STRUCT<nomeCompleto: STRING, dataNascimento: STRING, cpf: STRING, "
    "cartaoSus: STRING, nomeMae: STRING, sexo: STRING, racaCor: STRING, "
    "nacionalidade: STRING, logradouro: STRING, numero: STRING, complemento: STRING, "
    "bairro: STRING, cep: STRING, municipioResidencia: STRUCT<nome: STRING, uf: STRING>>, "
    f"operador {_ACTOR}, usuarioSolicitante {_ACTOR}, "
    "dataPrimeiroAgendamento STRING, dataPrimeiraAutorizacao STRING, "
    "regularizacaoAcesso STRING, statusProvisorio STRING, justificativaRetorno STRING, "
    "justificativaDuplicacao STRING, motivoPendencia STRING, motivoCancelamento STRING, "
    "motivoEncerramento STRING, descricaoEncerramento STRING, "
    "especialidade STRUCT<descricao: STRING, descricaoAuxiliar: STRING, "
    "especialidadeMae: STRUCT<descricao: STRING, cbo: STRUCT<descricao: STRING>>>, "
    "cidPrincipal STRUCT<codigo: STRING, descricao: STRING>, "
    "classificacaoRisco STRUCT<totalPontos: STRING, cor: STRING>, "
    "unidadeSolicitante STRUCT<nome: STRING>, "
    "evolucoes ARRAY<STRUCT<data: STRING, perfil: STRING, "
    "usuario: STRUCT<nome: STRING, cpf: STRING>, operacaoSolicitacao: STRING, "
    "situacaoAnterior: STRING, situacaoAtual: STRING, detalhes: STRING>>"
)

# The JSON text inside each history event.
DETAILS_DDL = (
    "itensEvolucao ARRAY<STRUCT<codigo: STRING, label: STRING, texto: STRING>>, "
    "entidade STRUCT<sistemaOrigem: STRING, complexidade: STRING, "
    "semClassificacao: VARIANT, cidPrincipal: STRUCT<codigo: STRING, descricao: STRING>, "
    f"especialidade: {_SPECIALTY}, classificacaoRisco: {_RISK}, "
    "foraDaRegionalizacao: VARIANT, possuiDita: VARIANT, "
    "municipioUsuarioSUS: STRUCT<nome: STRING, uf: STRING>, "
    f"unidadeOperador: {_UNIT_WITH_CENTRE}, unidadeReferencia: {_UNIT_WITH_CENTRE}, "
    f"centralRegulacao: STRUCT<{_UNIT_FIELDS}>>"
)

"""Request documents: contract, flattening, folds and the retired layouts.

The documents are JSON texts that Spark builds row by row from ``orders``, so their number
and the work on them grow with the table. The oracle computes the expected columns straight
from ``orders``, without any JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract
from ..operators.jsonshape import flatten_struct, millis_to_timestamps
from ..plans import flatten as fl, legacy
from ..schema import REQUEST_COLUMNS
from ..session import scratch_dir
from ..sources.files import write_parquet
from .views import table, view

C = F.col
SALT = "example-salt"
AS_OF = "2001-08-02"

# Plain columns of a document, in SQL both engines understand.
DOC = """
SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price,
  CAST(o_orderkey + 100000000000 AS VARCHAR(20)) AS cmce,
  CAST({ms} AS BIGINT) AS t0,
  CAST({ms} AS BIGINT) + (o_orderkey % 10) * 86400000 AS t1,
  CAST({ms} AS BIGINT) + CAST(1728000000 AS BIGINT) AS t2,
  CAST({ms} AS BIGINT) + CAST(2592000000 AS BIGINT) AS t3,
  CAST(o_custkey % 20000 AS BIGINT) * 777600000 AS born,
  CASE o_orderkey % 4 WHEN 0 THEN 'AUTORIZADA' WHEN 1 THEN 'PENDENTE' WHEN 2 THEN 'ENCAMINHADA_AO_NIR'
    ELSE 'EM_ANALISE' END AS s1,
  CASE WHEN o_orderstatus <> 'F' THEN 'AGENDADA' WHEN o_orderkey % 3 = 0 THEN 'REALIZADA'
    WHEN o_orderkey % 3 = 1 THEN 'CANCELADA' ELSE 'ENCERRADA' END AS s2,
  CONCAT('Medico ', CAST(o_custkey % 50 AS VARCHAR(20))) AS doctor,
  CONCAT('Regulador ', CAST(o_orderkey % 7 AS VARCHAR(20))) AS regulator,
  CONCAT('Paciente ', CAST(o_custkey AS VARCHAR(20))) AS patient,
  CONCAT('dor ', CAST(o_orderkey AS VARCHAR(20))) AS pain
FROM orders
"""
DOC_SPARK = DOC.format(ms="unix_millis(CAST(o_orderdate AS TIMESTAMP))")
DOC_DUCK = DOC.format(ms="epoch_ms(o_orderdate)")


def documents(spark, sf):
    """(protocolo, conteudo_json, origem_lista) with a four-event history out of order."""
    # narrow rows are dealt out before the heavy work per document, in as many partitions as the session uses
    s = view(spark, sf, DOC_SPARK).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")

    def items(*pairs):
        return F.array(*[F.struct(F.lit(code).alias("codigo"), F.lit(label).alias("label"), text.alias("texto"))
                         for code, label, text in pairs])

    unit = F.struct(F.concat(F.lit("UBS "), (C("c") % 9).cast("string")).alias("nome"),
                    F.lit("Prefeitura").alias("razaoSocial"),
                    F.struct(F.lit("Posto").alias("descricao")).alias("tipoUnidade"),
                    F.struct(F.lit("Cidade").alias("nome"), F.lit("RS").alias("uf")).alias("municipio"),
                    F.struct(F.lit("Central").alias("nome")).alias("centralRegulacao"))
    snapshot = F.struct(
        F.lit("WEB").alias("sistemaOrigem"), F.lit("ALTA").alias("complexidade"),
        (C("k") % 2 == 0).alias("semClassificacao"),
        F.struct(F.concat(F.lit("C"), (C("c") % 30).cast("string")).alias("codigo"),
                 C("pr").alias("descricao")).alias("cidPrincipal"),
        F.struct(F.concat(F.lit("Esp "), (C("c") % 40).cast("string")).alias("descricao"),
                 F.struct(F.lit("CBO 1").alias("descricao")).alias("cbo"),
                 F.struct(F.lit("Mae").alias("descricao")).alias("especialidadeMae"),
                 F.lit("sim").alias("teleconsulta"), (C("k") % 3).alias("ativa")).alias("especialidade"),
        F.struct((C("k") % 90).alias("totalPontos"), C("pr").alias("cor")).alias("classificacaoRisco"),
        unit.alias("unidadeOperador"))
    first = F.to_json(F.struct(
        items(("anamnese", "Anamnese", F.concat(F.lit(" "), C("pain"), F.lit(" forte\r\nha dias "))),
              ("regionalizacao", "Regiao", F.concat(F.lit("Especialidade: Esp:1\nReferencia :  "), C("pr"))),
              ("vazio", "Vazio", F.lit("   "))).alias("itensEvolucao"),
        snapshot.alias("entidade")))
    second = F.to_json(F.struct(items(
        ("evolucao", "Evolução", C("pain")), ("nota", "Nota", C("regulator")),
        ("anamnese", "Outra", F.concat(F.lit("nova "), C("pain")))).alias("itensEvolucao")))

    def event(at, state, before, user, details):
        return F.struct(at.alias("data"), F.lit("PERFIL").alias("perfil"),
                        F.struct(user.alias("nome"), F.lit("000").alias("cpf")).alias("usuario"),
                        F.concat(F.lit("OP "), state).alias("operacaoSolicitacao"),
                        before.alias("situacaoAnterior"), state.alias("situacaoAtual"), details.alias("detalhes"))

    events = F.array(
        event(C("t3"), F.lit("AGUARDA_REAVALIACAO"), C("s2"), C("regulator"), F.lit("no json")),
        event(C("t1"), C("s1"), F.lit("AGUARDA_REGULACAO"), C("regulator"), second),
        event(C("t0"), F.lit("AGUARDA_REGULACAO"), F.lit(""), C("doctor"), first),
        event(C("t2"), C("s2"), C("s1"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    # the second event may share its time with the first; array order then decides, so it is
    # moved behind it for the documents where that happens
    events = F.when(C("k") % 10 == 0, F.array(events[0], events[2], events[1], events[3])).otherwise(events)
    doc = F.struct(
        C("cmce").cast("bigint").alias("numeroCMCE"), C("s2").alias("situacao"),
        F.lit("AZUL").alias("corRegulador"), C("t0").alias("dataSolicitacao"),
        C("t2").alias("dataPrimeiroAgendamento"),
        F.when(C("k") % 2 == 0, F.lit("NAO")).alias("liminarOrdemJudicial"),
        C("t3").alias("dataAlterouUltimaSituacao"), F.lit("MEDIA").alias("complexidade"),
        F.struct(C("patient").alias("nomeCompleto"), C("born").alias("dataNascimento"),
                 F.lit(" 123 ").alias("cpf"), F.lit("Feminino").alias("sexo"),
                 F.lit("Rua A\nfundos").alias("logradouro"), (C("c") % 1000).cast("string").alias("numero"),
                 F.struct(F.lit("Cidade").alias("nome"), F.lit("RS").alias("uf")).alias("municipioResidencia"))
        .alias("usuarioSUS"),
        F.struct(F.lit("").alias("nome"), F.struct(C("regulator").alias("nome"), F.lit("77").alias("cpf"))
                 .alias("profissional")).alias("operador"),
        F.struct(C("doctor").alias("nome"), F.lit("a@b").alias("email")).alias("usuarioSolicitante"),
        F.struct(F.lit("Esp").alias("descricao"), F.struct(F.lit("Mae").alias("descricao")).alias("especialidadeMae"))
        .alias("especialidade"),
        F.struct((C("k") % 90).alias("totalPontos"), C("pr").alias("cor")).alias("classificacaoRisco"),
        events.alias("evolucoes"))
    return s.select(C("cmce").alias("protocolo"), F.to_json(doc).alias("conteudo_json"),
                    C("pr").alias("origem_lista"))


# --- oracle side ------------------------------------------------------------------

def _when(ms: str, fmt: str = "%d/%m/%Y %H:%M:%S") -> str:
    return f"strftime(make_timestamp({ms} * 1000), '{fmt}')"


def _days(ms: str) -> str:
    return f"CAST(printf('%.2f', ({ms}) / 86400000.0::DOUBLE) AS DOUBLE)"


_SNAP = """x AS (SELECT *, st = 'F' AS fin,
  CASE s1 WHEN 'ENCAMINHADA_AO_NIR' THEN 'REGULADOR' WHEN 'EM_ANALISE' THEN 'REGULADOR' ELSE 'SOLICITANTE' END AS o2
  FROM d),
y AS (SELECT *, CASE WHEN o2 = 'REGULADOR' THEN t2 - t1 ELSE 0 END + (t1 - t0)
    + CASE WHEN fin THEN 0 ELSE 996710400000 - t3 END AS reg,
  CASE WHEN o2 = 'SOLICITANTE' THEN t2 - t1 ELSE 0 END + CASE WHEN fin THEN 0 ELSE t3 - t2 END AS req FROM x)"""
_B0 = f"'[' || {_when('t0')} || ' | ' || doctor || ']'"
_B1 = f"'[' || {_when('t1')} || ' | ' || regulator || ']'"
_B2 = f"'[' || {_when('t2')} || ' | Sistema]'"
_B3 = f"'[' || {_when('t3')} || ' | ' || regulator || ']'"
_CLINIC = f"""{_B0} || ': ' || pain || ' forte' || {{br}} || 'ha dias || ' || {_B1} || ': ' || pain"""
_FULL = f"""{_B0} || ' -> OP AGUARDA_REGULACAO ( ➔ AGUARDA_REGULACAO) | Anamnese: ' || pain || ' forte' || {{br}}
  || 'ha dias | Regiao: Especialidade: Esp:1' || {{nl}} || 'Referencia :  ' || pr || ' || ' || {_B1} || ' -> OP ' || s1
  || ' (AGUARDA_REGULACAO ➔ ' || s1 || ') | Evolução: ' || pain || ' | Nota: ' || regulator || ' | Outra: nova ' || pain
  || ' || ' || {_B2} || ' -> OP ' || s2 || ' (' || s1 || ' ➔ ' || s2 || ')' || CASE WHEN fin THEN '' ELSE ' || ' || {_B3}
  || ' -> OP AGUARDA_REAVALIACAO (' || s2 || ' ➔ AGUARDA_REAVALIACAO)' END"""


def _ev_json(when: str, user: str, oper: str, before: str, state: str, items: str) -> str:
    return (f"""'{{"data":"' || {when} || '","usuario_nome":"' || {user} || '","usuario_cpf":"000","perfil":"PERFIL","""
            f""""operacaoSolicitacao":"OP ' || {oper} || '","situacaoAnterior":"' || {before} || '","situacaoAtual":"' """
            f"""|| {state} || '","detalhes_limpos":[' || {items} || ']}}'""")


def _item(label: str, text: str) -> str:
    return f"""'{{"label":"{label}","texto":"' || {text} || '"}}'"""


_JSON = ("'[' || " + _ev_json(_when("t0"), "doctor", "'AGUARDA_REGULACAO'", "''", "'AGUARDA_REGULACAO'",
         _item("Anamnese", "pain || ' forte\\r\\nha dias'") + " || ',' || "
         + _item("Regiao", "'Especialidade: Esp:1\\nReferencia :  ' || pr")) + " || ',' || "
         + _ev_json(_when("t1"), "regulator", "s1", "'AGUARDA_REGULACAO'", "s1",
                    _item("Evolução", "pain") + " || ',' || " + _item("Nota", "regulator") + " || ',' || "
                    + _item("Outra", "'nova ' || pain")) + " || ',' || "
         + _ev_json(_when("t2"), "'Sistema'", "s2", "s1", "s2", "''")
         + " || CASE WHEN fin THEN '' ELSE ',' || "
         + _ev_json(_when("t3"), "regulator", "'AGUARDA_REAVALIACAO'", "s2", "'AGUARDA_REAVALIACAO'", "''")
         + " END || ']'")

_EXPECTED = {
    "numeroCMCE": "cmce", "situacao": "s2", "origem_lista": "pr", "corRegulador": "'AZUL'",
    "dataSolicitacao": _when("t0"), "liminarOrdemJudicial": "CASE WHEN k % 2 = 0 THEN 'NAO' ELSE '' END",
    "usuarioSUS_nomeCompleto": f"sha256(lower(patient) || '{SALT}')",
    "usuarioSUS_dataNascimento": f"CASE WHEN born = 0 THEN '' ELSE {_when('born', '%d/%m/%Y')} END",
    "usuarioSUS_sexo": "'Feminino'", "usuarioSUS_cpf": f"sha256('123{SALT}')",
    "usuarioSUS_logradouro": "'Rua A  fundos'", "usuarioSUS_numero": "CAST(c % 1000 AS VARCHAR)",
    "usuarioSUS_municipioResidencia_nome": "'Cidade'", "usuarioSUS_municipioResidencia_uf": "'RS'",
    "operador_nome": "regulator", "operador_cpf": f"sha256('77{SALT}')",
    "usuarioSolicitante_nome": "doctor", "dataPrimeiroAgendamento": _when("t2"),
    "entidade_sistemaOrigem": "'WEB'", "entidade_complexidade": "'ALTA'",
    "entidade_semClassificacao": "k % 2 = 0",
    "entidade_cidPrincipal_codigo": "'C' || CAST(c % 30 AS VARCHAR)", "entidade_cidPrincipal_descricao": "pr",
    "entidade_especialidade_descricao": "'Esp ' || CAST(c % 40 AS VARCHAR)",
    "entidade_especialidade_cbo_descricao": "'CBO 1'",
    "entidade_especialidade_especialidadeMae_descricao": "'Mae'",
    "entidade_especialidade_teleconsulta": "TRUE", "entidade_especialidade_ativa": "k % 3 <> 0",
    "entidade_especialidade_matriciamento": "FALSE", "entidade_especialidade_tipoOCI": "FALSE",
    "entidade_classificacaoRisco_totalPontos": "CAST(k % 90 AS VARCHAR)",
    "entidade_classificacaoRisco_pontosGravidade": "'0'", "entidade_classificacaoRisco_pontosTempo": "'0'",
    "entidade_classificacaoRisco_cor": "pr",
    "entidade_classificacaoRisco_reclassificadaSolicitante": "FALSE",
    "entidade_foraDaRegionalizacao": "FALSE", "entidade_possuiDita": "FALSE",
    "entidade_unidadeOperador_nome": "'UBS ' || CAST(c % 9 AS VARCHAR)",
    "entidade_unidadeOperador_razaoSocial": "'Prefeitura'",
    "entidade_unidadeOperador_tipoUnidade_descricao": "'Posto'",
    "entidade_unidadeOperador_municipio_nome": "'Cidade'", "entidade_unidadeOperador_municipio_uf": "'RS'",
    "entidade_unidadeOperador_centralRegulacao_nome": "'Central'",
    "SLA_Tempo_Solicitante_Dias": _days("req"), "SLA_Tempo_Regulador_Dias": _days("reg"),
    "SLA_Lead_Time_Total_Dias": _days("req + reg"),
    "SLA_Interacoes_Regulacao": "1 + CAST(s1 = 'ENCAMINHADA_AO_NIR' AS BIGINT) + CAST(NOT fin AS BIGINT)",
    "SLA_Atores_Envolvidos": "doctor || ' | ' || regulator", "SLA_Desfecho_Atingido": "fin",
    "SLA_Tipo_Desfecho": """CASE WHEN NOT fin THEN '' WHEN s2 = 'REALIZADA' THEN 'POSITIVO'
      WHEN s2 = 'CANCELADA' THEN 'NEGATIVO' ELSE 'ABANDONO' END""",
    "SLA_Marco_Autorizada": "s1 = 'AUTORIZADA'", "SLA_Marco_Agendada": "s2 = 'AGENDADA'",
    "SLA_Marco_Realizada": "s2 = 'REALIZADA'",
    "dataCadastro": _when("t0"), "medicoSolicitante": "doctor",
    "historico_quadro_clinico": _CLINIC.format(br="' '"),
    "historico_evolucoes_completo": _FULL.format(br="' '", nl="'  '"), "evolucoes_json": _JSON,
}


def flat_request(spark, sf):
    """Canonical flat rows of all documents."""
    return fl.canonical(fl.flatten(documents(spark, sf), AS_OF, SALT))


def _flat_sql(columns):
    cells = ", ".join(f"{_EXPECTED.get(c, repr(''))} AS \"{c}\"" for c in columns)
    return f"WITH d AS ({DOC_DUCK}), {_SNAP} SELECT {cells} FROM y"


def clinical_fold(spark, sf):
    """clinical texts with their original line breaks."""
    return fl.flatten(documents(spark, sf), AS_OF, SALT).select("numeroCMCE", "historico_quadro_clinico")


def full_history_fold(spark, sf):
    """complete history text with its original line breaks."""
    return fl.flatten(documents(spark, sf), AS_OF, SALT).select("numeroCMCE", "historico_evolucoes_completo")


def actors_joined(spark, sf):
    """Sorted distinct actors of each document."""
    return fl.flatten(documents(spark, sf), AS_OF, SALT).select("numeroCMCE", "SLA_Atores_Envolvidos")


def chronological_sort(spark, sf):
    """Events of each document in time order, ties in document order."""
    d = documents(spark, sf).select("protocolo", fl.parse_document(C("conteudo_json")).alias("d"))
    return d.select("protocolo", F.posexplode(F.expr(fl.sorted_events("d.evolucoes"))).alias("pos", "e")).select(
        "protocolo", "pos", C("e.ms").alias("ms"), C("e.e.situacaoAtual").alias("state"))


CHRONO_SQL = f"""WITH d AS ({DOC_DUCK})
SELECT cmce AS protocolo, CAST(0 AS INTEGER) AS pos, t0 AS ms, 'AGUARDA_REGULACAO' AS state FROM d
UNION ALL SELECT cmce, 1, t1, s1 FROM d UNION ALL SELECT cmce, 2, t2, s2 FROM d
UNION ALL SELECT cmce, 3, t3, 'AGUARDA_REAVALIACAO' FROM d"""


# --- contract ---------------------------------------------------------------------

def _damaged(spark, sf):
    """Documents with several kinds of damage, chosen by key, stored as a raw dataset."""
    k = C("protocolo").cast("bigint") % 12
    j = C("conteudo_json")
    broken = (F.when(k == 1, F.replace(j, F.lit('"numeroCMCE":'), F.lit('"outro":')))
              .when(k == 2, F.regexp_replace(j, '"situacao":"[A-Z]+"', '"situacao":5'))
              .when(k == 3, F.lit("not json"))
              .when(k == 4, F.lit('{"error": "timeout"}'))
              .when(k == 5, F.replace(j, F.lit('"nomeCompleto"'), F.lit('"apelido"')))
              .when(k == 6, F.regexp_replace(j, '"numeroCMCE":([0-9]+)', '"numeroCMCE":"$1"'))
              .when(k == 7, F.regexp_replace(j, '"dataNascimento":[0-9]+', '"dataNascimento":"ontem"'))
              .when(k == 8, F.regexp_replace(j, '"detalhes":"no json"', '"detalhes":7'))
              .when(k == 9, F.lit("null")).otherwise(j))
    path = scratch_dir(spark, "raw")
    write_parquet(documents(spark, sf).withColumn("conteudo_json", broken), path)
    return spark.read.parquet(path)


def contract_split(spark, sf):
    """Every document is good or has its violations listed."""
    return contract.with_errors(_damaged(spark, sf)).select(
        "protocolo", F.array_join("errors", "; ").alias("problems"))


CONTRACT_SQL = f"""WITH d AS ({DOC_DUCK})
SELECT cmce AS protocolo, CASE CAST(cmce AS BIGINT) % 12 WHEN 1 THEN 'numeroCMCE: missing'
  WHEN 2 THEN 'situacao: wrong type' WHEN 3 THEN 'payload: corrupt' WHEN 4 THEN 'payload: corrupt'
  WHEN 5 THEN 'usuarioSUS.nomeCompleto: missing' WHEN 7 THEN 'usuarioSUS.dataNascimento: wrong type'
  WHEN 8 THEN 'evolucoes.detalhes: wrong type' WHEN 9 THEN 'payload: corrupt' ELSE '' END AS problems FROM d"""


# --- retired layouts --------------------------------------------------------------

def legacy_flat_32(spark, sf):
    """The 32-heading layout."""
    return legacy.flat_32(documents(spark, sf))


_BORN = f"CASE WHEN born = 0 THEN '' ELSE {_when('born', '%d/%m/%Y')} END"
_KEY = "cmce[1:2] || '-' || cmce[3:4] || '-' || cmce[5:11] || '-' || cmce[12:12]"
_L32 = {
    "Protocolo": _KEY, "Especialidade Mãe": "'Mae'", "Especialidade": "'Esp'",
    "Situação da Solicitação": "s2", "Data da Solicitação": _when("t0"),
    "Data do Primeiro Agendamento": _when("t2"), "Pontuação": "CAST(k % 90 AS VARCHAR)",
    "Pontuação Cor": "pr", "Complexidade": "'MEDIA'", "Cor do Regulador": "'AZUL'",
    "Médico Solicitante": "doctor", "Médico Solicitante Email": "'a@b'",
    "Quadro Clínico": "'nova ' || pain", "Nome do Paciente": "patient", "Data de Nascimento": _BORN,
    "Sexo": "'Feminino'", "CPF": "' 123 '", "Logradouro": "'Rua A' || chr(10) || 'fundos'",
    "Número": "CAST(c % 1000 AS VARCHAR)", "Ordem Judicial": "CASE WHEN k % 2 = 0 THEN 'NAO' ELSE '' END",
}
L32_SQL = f"WITH d AS ({DOC_DUCK}) SELECT " + ", ".join(
    f"{_L32.get(c, repr(''))} AS \"{c}\"" for c in legacy.COLUMNS_32) + " FROM d"


def legacy_flat_16(spark, sf):
    """The 16-heading layout with the text history."""
    return legacy.flat_16(documents(spark, sf))


_MIN = "%d/%m/%Y %H:%M"
_H0, _H1 = (f"'[' || {_when(t, _MIN)} || ' - '" for t in ("t0", "t1"))
_L16 = {
    "Protocolo": _KEY, "Situação": "s2", "Origem da Lista": "pr", "Data Solicitação": _when("t0", _MIN),
    "Data Nascimento": _BORN, "Paciente": "patient", "CPF": "' 123 '", "Especialidade": "'Esp'",
    "Complexidade": "'MEDIA'", "Risco Cor": "pr", "Pontuação": "CAST(k % 90 AS VARCHAR)",
    "Histórico Quadro Clínico": f"""{_H0} || 'Anamnese - ' || doctor || ']: ' || pain || ' forte' || chr(13) || chr(10)
      || 'ha dias | ' || {_H0} || 'Regiao - ' || doctor || ']: Especialidade: Esp:1' || chr(10) || 'Referencia :  ' || pr
      || ' | ' || {_H1} || 'Evolução - ' || regulator || ']: ' || pain || ' | ' || {_H1} || 'Nota - ' || regulator
      || ']: ' || regulator || ' | ' || {_H1} || 'Outra - ' || regulator || ']: nova ' || pain""",
}
L16_SQL = f"WITH d AS ({DOC_DUCK}) SELECT " + ", ".join(
    f"{_L16.get(c, repr(''))} AS \"{c}\"" for c in legacy.COLUMNS_16) + " FROM d"


def by_code_last(spark, sf):
    """last item text per code."""
    items = legacy.parsed_documents(documents(spark, sf)).select(
        "protocolo", F.expr(legacy.all_items()).alias("items"))
    return items.select("protocolo", F.size("items").cast("bigint").alias("n_items"),
                        *[F.expr(legacy.by_code_last("items", code)).alias(code)
                          for code in ["anamnese", "nota", "unidadeIndicada"]])


def nested_items(spark, sf):
    """the items of all events of all documents, one row each."""
    items = legacy.parsed_documents(documents(spark, sf)).select("protocolo", F.expr(legacy.all_items()).alias("items"))
    return items.select("protocolo", F.inline("items")).select("protocolo", "codigo", "label", F.md5("texto").alias("texto"))


ITEMS_SQL = f"""WITH d AS ({DOC_DUCK}), i AS (
  SELECT cmce, 'anamnese' AS codigo, 'Anamnese' AS label, ' ' || pain || ' forte' || chr(13) || chr(10) || 'ha dias ' AS t FROM d
  UNION ALL SELECT cmce, 'regionalizacao', 'Regiao', 'Especialidade: Esp:1' || chr(10) || 'Referencia :  ' || pr FROM d
  UNION ALL SELECT cmce, 'vazio', 'Vazio', '   ' FROM d UNION ALL SELECT cmce, 'evolucao', 'Evolução', pain FROM d
  UNION ALL SELECT cmce, 'nota', 'Nota', regulator FROM d UNION ALL SELECT cmce, 'anamnese', 'Outra', 'nova ' || pain FROM d)
SELECT cmce AS protocolo, codigo, label, md5(t) AS texto FROM i"""


def kv_lines(spark, sf):
    """'key: value' lines as columns."""
    items = legacy.parsed_documents(documents(spark, sf)).select(
        "protocolo", F.expr(legacy.all_items()).alias("items"))
    values = items.select("protocolo", legacy.regional_values("items").alias("m"))
    return values.select("protocolo", F.explode("m").alias("name", "value"))


def _texts(spark, sf):
    """Text histories built from the documents table: one history item per line of text."""
    d = table(spark, sf, "documents")
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        F.lit("\n\n["), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (i % 700).cast("int")), "dd/MM/yyyy"),
        F.lit(" | Tipo "), C("lang"), F.lit(" | "), C("source"), F.lit("]: "), line, F.lit("\n| fim")))
    return d.select("doc_id", F.array_join(lines, " | ").alias(legacy.HISTORY_COLUMN))


def split_explode(spark, sf):
    """Split with look-ahead, explode, trim; whole texts."""
    item = F.explode(F.split(C(legacy.HISTORY_COLUMN), legacy.HISTORY_SPLIT))
    return (_texts(spark, sf).select("doc_id", item.alias("item")).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("item")).alias("chars")))


def regex_groups(spark, sf):
    """Dated history items."""
    return legacy.explode_history(_texts(spark, sf)).select(
        "doc_id", C("Data_Evolucao").cast("date").alias("Data_Evolucao"), "Tipo_Informacao",
        "Origem_Informacao", F.md5("Texto_Evolucao").alias("texto"))


_LINES = """l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
h AS (SELECT doc_id, lang, source, DATE '2020-01-01' + CAST(i % 700 AS INTEGER) AS day, i, line,
  line || chr(10) || '| fim' AS body, COUNT(*) OVER (PARTITION BY doc_id) AS n FROM l)"""
SPLIT_SQL = f"""WITH {_LINES} SELECT doc_id, COUNT(*) AS n,
  CAST(SUM(length(chr(10) || chr(10) || '[01/01/2020 | Tipo ' || lang || ' | ' || source || ']: ' || body)) AS BIGINT)
  AS chars FROM h GROUP BY doc_id"""
GROUPS_SQL = f"""WITH {_LINES} SELECT doc_id, day AS "Data_Evolucao", 'Tipo ' || lang AS "Tipo_Informacao",
  source AS "Origem_Informacao", md5(ltrim(body, ' ' || chr(10) || chr(9) || chr(13))) AS texto FROM h"""


# --- generic JSON -----------------------------------------------------------------

def json_flatten(spark, sf):
    """nested JSON to flat columns named by path, millisecond columns as dates."""
    e = table(spark, sf, "events")
    ms = F.unix_millis(C("ts").cast("timestamp"))
    text = F.to_json(F.struct("event_id", F.struct(C("event_type").alias("kind"), F.struct(
        ms.alias("dataCriacao"), C("value").alias("score")).alias("inner")).alias("body")))
    parsed = e.select(F.from_json(
        text, "event_id BIGINT, body STRUCT<kind: STRING, inner: STRUCT<dataCriacao: BIGINT, score: DOUBLE>>").alias("j"))
    flat = millis_to_timestamps(flatten_struct(parsed.select("j.*")))
    return flat.withColumn("body_inner_dataCriacao",
                           F.date_format("body_inner_dataCriacao", "yyyy-MM-dd HH:mm:ss"))


def json_nested(spark, sf):
    """JSON inside JSON with defaults at each level."""
    e = table(spark, sf, "events")
    inner = F.when(C("event_id") % 5 == 0, "oops").when(C("event_id") % 5 == 1, None).otherwise(
        F.concat(F.lit("  "), C("props")))
    text = F.to_json(F.struct(F.struct(inner.alias("detalhes")).alias("a")))
    outer = e.select("event_id", F.from_json(text, "a STRUCT<detalhes: STRING>").alias("o"))
    inside = outer.withColumn("d", F.expr(fl.parse_details("o.a.detalhes", f"k BIGINT, {fl.CORRUPT} STRING")))
    return inside.selectExpr("event_id", f"coalesce({fl.intact('d', 'k')}, -1) AS k")


QUERIES = {
    "flat_request": (flat_request, _flat_sql(REQUEST_COLUMNS)),
    "clinical_fold": (clinical_fold, f"""WITH d AS ({DOC_DUCK}), {_SNAP} SELECT cmce AS "numeroCMCE",
        {_CLINIC.format(br="chr(13) || chr(10)")} AS historico_quadro_clinico FROM y"""),
    "full_history_fold": (full_history_fold, f"""WITH d AS ({DOC_DUCK}), {_SNAP} SELECT cmce AS "numeroCMCE",
        {_FULL.format(br="chr(13) || chr(10)", nl="chr(10)")} AS historico_evolucoes_completo FROM y"""),
    "actors_joined": (actors_joined, f"""WITH d AS ({DOC_DUCK}) SELECT cmce AS "numeroCMCE",
        doctor || ' | ' || regulator AS "SLA_Atores_Envolvidos" FROM d"""),
    "chronological_sort": (chronological_sort, CHRONO_SQL),
    "contract_split": (contract_split, CONTRACT_SQL),
    "legacy_flat_32": (legacy_flat_32, L32_SQL),
    "legacy_flat_16": (legacy_flat_16, L16_SQL),
    "by_code_last": (by_code_last, f"""WITH d AS ({DOC_DUCK}) SELECT cmce AS protocolo, CAST(6 AS BIGINT) AS n_items,
        'nova ' || pain AS anamnese, regulator AS nota, CAST(NULL AS VARCHAR) AS "unidadeIndicada" FROM d"""),
    "nested_items": (nested_items, ITEMS_SQL),
    "kv_lines": (kv_lines, f"""WITH d AS ({DOC_DUCK}) SELECT cmce AS protocolo,
        'Regionalização Especialidade' AS name, 'Esp:1' AS value FROM d
        UNION ALL SELECT cmce, 'Regionalização Referencia', pr FROM d"""),
    "split_explode": (split_explode, SPLIT_SQL),
    "regex_groups": (regex_groups, GROUPS_SQL),
    "json_flatten": (json_flatten, """SELECT event_id, event_type AS body_kind,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS "body_inner_dataCriacao", value AS body_inner_score FROM events"""),
    "json_nested": (json_nested, """SELECT event_id, CASE WHEN event_id % 5 < 2 THEN -1
        ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events"""),
}

"""Filter predicates, text search, row security and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import sqltext
from ..operators import access, predicates as p
from ..rules import DEFAULT_RULES
from .views import (AS_OF_EVENTS, AS_OF_ORDERS, REQUESTS, REQUESTS_PLACE, duck, requests,
                    requests_place, table)

AS_OF = AS_OF_ORDERS
D = f"DATE '{AS_OF}'"
C = F.col
SALT = "example-salt"


def _filtered(where, *columns):
    """Query over the request view: rows that meet a predicate."""
    def query(spark, sf):
        return requests(spark, sf).filter(where()).select("numeroCMCE", *columns)
    return query


def _where(sql: str, *columns: str) -> str:
    return duck(f"SELECT {', '.join(('numeroCMCE',) + columns)} FROM v WHERE {sql}", v=REQUESTS)


include_exclude = _filtered(lambda: p.all_of([
    p.include(C("entidade_classificacaoRisco_cor"), ["VERMELHO", "AMARELO"]),
    p.exclude(C("SLA_Tipo_Desfecho"), ["POSITIVO"])]), "SLA_Tipo_Desfecho")
tristate = _filtered(lambda: p.any_of([
    p.is_no(C("SLA_Desfecho_Atingido")) & (C("numeroCMCE") % 2 == 0),
    p.is_yes(C("SLA_Desfecho_Atingido")) & (C("entidade_classificacaoRisco_cor") == "VERDE")]),
    "SLA_Desfecho_Atingido")
presence = _filtered(lambda: p.any_of([
    p.present(C("liminarOrdemJudicial")) & p.absent(C("SLA_Tipo_Desfecho")),
    p.absent(C("liminarOrdemJudicial")) & p.present(C("SLA_Tipo_Desfecho"))]),
    "liminarOrdemJudicial", "SLA_Tipo_Desfecho")
num_range = _filtered(lambda: p.all_of([
    p.int_range(C("entidade_classificacaoRisco_totalPontos"), 100000, 200000, from_text=False),
    p.int_range(C("usuarioSUS_numero"), 10, 500)]), "usuarioSUS_numero")
date_range = _filtered(lambda: p.date_range(C("dataSolicitacao"), "1998-03-01", "1998-06-30"),
                       "situacao")
age_range = _filtered(lambda: p.value_range(
    fn.age_years(C("usuarioSUS_dataNascimento"), F.lit(AS_OF)), 18, 40), "usuarioSUS_dataNascimento")
outcome = _filtered(lambda: p.all_of([
    p.outcome_include(C("SLA_Tipo_Desfecho"), ["POSITIVO", "ABANDONO", p.IN_PROGRESS]),
    p.outcome_exclude(C("SLA_Tipo_Desfecho"), ["ABANDONO"])]), "SLA_Tipo_Desfecho")
in_progress_excluded = _filtered(lambda: p.outcome_exclude(
    C("SLA_Tipo_Desfecho"), [p.IN_PROGRESS, "NEGATIVO"]), "SLA_Tipo_Desfecho")
spec_tree = _filtered(lambda: (
    p.urgent(C("entidade_classificacaoRisco_cor"), DEFAULT_RULES.urgent_colours)
    & ~p.waiting_longer(C("dataSolicitacao"), AS_OF, 700)) | p.all_of(
    [p.waiting_longer(C("dataSolicitacao"), AS_OF, 2000),
     C("entidade_classificacaoRisco_cor") == "VERDE"]), "dataSolicitacao")


def regex_filter(spark, sf):
    """Values read out of, and matched in, the pending-reason text."""
    m = C("motivoPendencia")
    r = requests(spark, sf).filter(p.present(m))
    return (r.filter(p.pending_match(m, ["falta exame (3)", "falta exame (5)"])
                     & p.pending_no_match(m, ["fechada"]))
            .select("numeroCMCE", *[p.pending_value(m, f).alias(f) for f in p.PENDING_PATTERNS]))


_PENDING_SQL = ", ".join("regexp_extract(motivoPendencia, '{}', 1) AS {}".format(pattern.replace("'", "''"), name)
                         for name, pattern in p.PENDING_PATTERNS.items())
REGEX_SQL = duck(rf"""SELECT numeroCMCE, {_PENDING_SQL}
FROM v WHERE motivoPendencia IS NOT NULL AND motivoPendencia <> ''
  AND regexp_matches(motivoPendencia, '(?i)falta exame \(3\)|falta exame \(5\)')
  AND NOT regexp_matches(motivoPendencia, '(?i)fechada')""", v=REQUESTS)


def predicate_rows(spark, sf):
    """Predicates as result columns, three-valued."""
    r = requests(spark, sf)
    urgent = p.urgent(C("entidade_classificacaoRisco_cor"), DEFAULT_RULES.urgent_colours)
    overdue = p.waiting_longer(C("dataSolicitacao"), AS_OF, DEFAULT_RULES.sla_days)
    outcome_is = C("SLA_Tipo_Desfecho") == "POSITIVO"
    return r.select("numeroCMCE", urgent.alias("urgent"), overdue.alias("overdue"),
                    (urgent & outcome_is).alias("both"), (urgent | outcome_is).alias("either"),
                    (~outcome_is).alias("negated"), p.all_of([]).alias("empty_clause"),
                    p.present(C("SLA_Tipo_Desfecho")).alias("non_empty"))


PREDICATE_SQL = duck(f"""SELECT numeroCMCE,
  entidade_classificacaoRisco_cor IN ('VERMELHO','LARANJA','AMARELO') AS urgent,
  date_diff('day', CAST(dataSolicitacao AS DATE), {D}) > 180 AS overdue,
  (entidade_classificacaoRisco_cor IN ('VERMELHO','LARANJA','AMARELO') AND SLA_Tipo_Desfecho = 'POSITIVO') AS both,
  (entidade_classificacaoRisco_cor IN ('VERMELHO','LARANJA','AMARELO') OR SLA_Tipo_Desfecho = 'POSITIVO') AS either,
  NOT (SLA_Tipo_Desfecho = 'POSITIVO') AS negated, 1=1 AS empty_clause,
  (SLA_Tipo_Desfecho <> '' AND SLA_Tipo_Desfecho IS NOT NULL) AS non_empty FROM v""", v=REQUESTS)


# --- text search ------------------------------------------------------------------

def _text(where):
    def query(spark, sf):
        return table(spark, sf, "documents").filter(where()).select("doc_id", "lang")
    return query


def _like(*patterns: str, join: str = " OR ", negate: bool = False) -> str:
    return "(" + join.join(
        f"strip_accents(text) {'NOT ' if negate else ''}ILIKE strip_accents('{x}')"
        for x in patterns) + ")"


text_any = _text(lambda: p.text_any(C("text"), "éaux, THAT with, dec*la"))
text_all = _text(lambda: p.text_all(C("text"), "Éle, *que*aux*"))
text_none = _text(lambda: p.text_none(C("text"), "étion,the"))


def text_entity(spark, sf):
    """Conversations whose turns match any / all / none of the terms."""
    c = table(spark, sf, "conversations")
    return p.entity_text(c, "conv_id", "text", any_terms="mentré, oneth", all_terms="er",
                         no_terms="quezal").select("conv_id", "turn", "role")


ENTITY_SQL = f"""SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (
  SELECT conv_id FROM conversations GROUP BY conv_id HAVING
  (bool_or({_like('%mentré%')}) OR bool_or({_like('%oneth%')})) AND bool_or({_like('%er%')})
  AND bool_or({_like('%quezal%')}) = FALSE)"""


def accent_fold(spark, sf):
    """F16: canonical accent removal of whole texts."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(fn.fold_accents(C("text"))).alias("folded"))


# --- row security -----------------------------------------------------------------

def secured_view(spark, sf):
    """Rows a known and an unknown caller see."""
    r = requests(spark, sf)
    known = access.secured(r, "analyst").select(F.lit("known").alias("caller"), "numeroCMCE")
    unknown = access.secured(r, None).select(F.lit("unknown").alias("caller"), "numeroCMCE")
    return known.unionByName(unknown)


def cascading_options(spark, sf):
    """Option lists, each under all earlier filters."""
    r = requests_place(spark, sf)
    return access.cascading_options(r, {
        "origem_lista": p.include(C("origem_lista"), ["BUILDING", "MACHINERY"]),
        "usuarioSUS_municipioResidencia_nome": p.exclude(
            C("usuarioSUS_municipioResidencia_nome"), ["NATION_3"]),
        "situacao": p.include(C("situacao"), ["AGENDADA"]),
        "usuarioSUS_bairro": None})


CASCADE_SQL = duck("""SELECT DISTINCT 'origem_lista' AS "column", origem_lista AS value FROM v WHERE origem_lista <> ''
UNION ALL SELECT DISTINCT 'usuarioSUS_municipioResidencia_nome', usuarioSUS_municipioResidencia_nome FROM v
  WHERE origem_lista IN ('BUILDING','MACHINERY') AND usuarioSUS_municipioResidencia_nome <> ''
UNION ALL SELECT DISTINCT 'situacao', situacao FROM v WHERE origem_lista IN ('BUILDING','MACHINERY')
  AND usuarioSUS_municipioResidencia_nome NOT IN ('NATION_3') AND situacao <> ''
UNION ALL SELECT DISTINCT 'usuarioSUS_bairro', usuarioSUS_bairro FROM v
  WHERE origem_lista IN ('BUILDING','MACHINERY') AND usuarioSUS_municipioResidencia_nome NOT IN ('NATION_3')
  AND situacao IN ('AGENDADA') AND usuarioSUS_bairro IS NOT NULL AND usuarioSUS_bairro <> ''""",
                   v=REQUESTS_PLACE)


def custom_sql(spark, sf):
    """A caller's SQL over the secured frame."""
    return access.custom_sql(
        spark, """WITH t AS (SELECT situacao, COUNT(*) AS n, MAX(dataSolicitacao) AS last FROM {requests}
                  GROUP BY situacao) SELECT situacao, n, CAST(last AS DATE) AS last FROM t WHERE n > 10""",
        requests(spark, sf), "analyst", C("entidade_classificacaoRisco_cor") != "")


CUSTOM_SQL = duck("""SELECT situacao, COUNT(*) AS n, CAST(MAX(dataSolicitacao) AS DATE) AS last FROM v
  WHERE entidade_classificacaoRisco_cor <> '' GROUP BY situacao HAVING COUNT(*) > 10""", v=REQUESTS)


# --- key gates --------------------------------------------------------------------

def valid_key_gate(spark, sf):
    """Rows whose trimmed key is not empty."""
    r = requests(spark, sf).withColumn("key", F.when(C("numeroCMCE") % 4 == 0, "  ").when(
        C("numeroCMCE") % 4 == 1, F.concat(F.lit(" "), C("numeroCMCE").cast("string"))))
    return r.filter(p.valid_key(C("key"))).select("numeroCMCE", "key")


KEY_SQL = duck("""SELECT numeroCMCE, key FROM (SELECT numeroCMCE, CASE WHEN numeroCMCE % 4 = 0 THEN '  '
  WHEN numeroCMCE % 4 = 1 THEN ' ' || CAST(numeroCMCE AS VARCHAR) END AS key FROM v)
  WHERE key IS NULL OR trim(key) <> ''""", v=REQUESTS)


def legacy_key_gate(spark, sf):
    """Keys of the retired layout contain a dash."""
    o = table(spark, sf, "orders").withColumn("key", F.when(
        C("o_orderkey") % 3 == 0, C("o_orderpriority")).otherwise(F.nullif(C("o_orderstatus"), F.lit("P"))))
    return o.filter(p.valid_legacy_key(C("key"))).select("o_orderkey", "key")


LEGACY_KEY_SQL = """SELECT o_orderkey, key FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0
  THEN o_orderpriority ELSE NULLIF(o_orderstatus, 'P') END AS key FROM orders) WHERE contains(key, '-')"""


def lookup_by_hash(spark, sf):
    """Find one person by the hash of the name."""
    c = table(spark, sf, "customer").withColumn("hashed", fn.hash_raw(C("c_name"), SALT))
    wanted = fn.hash_raw(F.lit("Customer#000000042"), SALT)
    return c.filter(C("hashed") == wanted).select("c_custkey", "hashed")


LOOKUP_SQL = f"""SELECT c_custkey, sha256(c_name || '{SALT}') AS hashed FROM customer
  WHERE sha256(c_name || '{SALT}') = sha256('Customer#000000042' || '{SALT}')"""


# --- scalar functions -------------------------------------------------------------

def pii_hash(spark, sf):
    """Normalised and raw identity hashes."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", fn.hash_identity(F.concat(F.lit("  "), C("c_name"), F.lit(" ")), SALT)
                    .alias("identity"),
                    fn.hash_raw(F.nullif(C("c_mktsegment"), F.lit("BUILDING")), SALT).alias("raw"),
                    fn.hash_identity(F.lit(None).cast("string"), SALT).alias("missing"))


PII_SQL = f"""SELECT c_custkey, sha256(lower(trim('  ' || c_name || ' ')) || '{SALT}') AS "identity",
  sha256(NULLIF(c_mktsegment, 'BUILDING') || '{SALT}') AS raw, '' AS missing FROM customer"""


def epoch_text(spark, sf):
    """Epoch milliseconds as day-first text in three precisions."""
    e = table(spark, sf, "events")
    ms = F.unix_millis(C("ts").cast("timestamp"))
    ms = F.when(C("event_id") % 10 == 0, 0).otherwise(ms)
    return e.select("event_id", fn.epoch_text(ms).alias("seconds"),
                    fn.epoch_text(ms, "dd/MM/yyyy HH:mm").alias("minutes"),
                    fn.epoch_date_text(ms.cast("string")).alias("day"),
                    fn.epoch_text(F.concat(F.lit("x"), ms.cast("string"))).alias("bad"))


EPOCH_SQL = """SELECT event_id,
  CASE WHEN event_id % 10 = 0 THEN '' ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS seconds,
  CASE WHEN event_id % 10 = 0 THEN '' ELSE strftime(ts, '%d/%m/%Y %H:%M') END AS minutes,
  CASE WHEN event_id % 10 = 0 THEN '' ELSE strftime(ts, '%d/%m/%Y') END AS day, '' AS bad FROM events"""


def lenient_cast(spark, sf):
    """casts that turn bad values into null or 0."""
    r = requests(spark, sf)
    text = F.when(C("numeroCMCE") % 3 == 0, F.date_format("dataSolicitacao", "dd/MM/yyyy HH:mm:ss")) \
        .when(C("numeroCMCE") % 3 == 1, F.date_format("dataSolicitacao", "dd/MM/yyyy")).otherwise("99/99/2000")
    return r.select("numeroCMCE", fn.lenient_int(C("usuarioSUS_numero")).alias("from_text"),
                    fn.lenient_int(C("SLA_Lead_Time_Total_Dias"), from_text=False).alias("from_number"),
                    fn.coerce_number(C("usuarioSUS_numero")).alias("coerced"),
                    C("usuarioSUS_dataNascimento").try_cast("date").alias("as_date"),
                    fn.day_first_timestamp(text).cast("date").alias("day_first"),
                    fn.clean_missing_text(F.when(C("numeroCMCE") % 3 == 0, "nan")
                                          .when(C("numeroCMCE") % 3 == 1, C("situacao"))).alias("clean"))


CAST_SQL = duck("""SELECT numeroCMCE, TRY_CAST(usuarioSUS_numero AS INTEGER) AS from_text,
  TRY_CAST(SLA_Lead_Time_Total_Dias AS INTEGER) AS from_number,
  COALESCE(TRY_CAST(usuarioSUS_numero AS DOUBLE), 0.0) AS coerced,
  TRY_CAST(usuarioSUS_dataNascimento AS DATE) AS as_date,
  CASE WHEN numeroCMCE % 3 < 2 THEN CAST(dataSolicitacao AS DATE) END AS day_first,
  CASE WHEN numeroCMCE % 3 = 1 THEN situacao ELSE '' END AS clean FROM v""", v=REQUESTS)


def key_format(spark, sf):
    """12-digit keys with dashes."""
    r = requests(spark, sf)
    key = F.when(C("numeroCMCE") % 5 == 0, C("numeroCMCE")).otherwise(C("numeroCMCE") + 100000000000)
    return r.select("numeroCMCE", fn.format_key(key).alias("protocolo"))


KEY_FORMAT_SQL = duck("""SELECT numeroCMCE, CASE WHEN length(k) = 12
  THEN k[1:2] || '-' || k[3:4] || '-' || k[5:11] || '-' || k[12:12] ELSE k END AS protocolo
  FROM (SELECT numeroCMCE, CAST(CASE WHEN numeroCMCE % 5 = 0 THEN numeroCMCE
    ELSE numeroCMCE + 100000000000 END AS VARCHAR) AS k FROM v)""", v=REQUESTS)


def age_text(spark, sf):
    """age as text with birthday check."""
    r = requests(spark, sf)
    return r.select("numeroCMCE", fn.age_text(C("usuarioSUS_dataNascimento").try_cast("date"),
                                              F.lit(AS_OF)).alias("idade"))


AGE_TEXT_SQL = duck(f"""SELECT numeroCMCE, CASE WHEN b IS NULL THEN '' ELSE
  CAST(year({D}) - year(b) - CAST(month({D}) * 100 + day({D}) < month(b) * 100 + day(b) AS INTEGER)
    AS VARCHAR) || ' anos e '
  || CAST((month({D}) - month(b) + 12) % 12 AS VARCHAR) || ' meses' END AS idade
  FROM (SELECT numeroCMCE, TRY_CAST(usuarioSUS_dataNascimento AS DATE) AS b FROM v)""", v=REQUESTS)


def linebreaks(spark, sf):
    """both line-break rules and the strip rule over whole texts."""
    d = table(spark, sf, "documents")
    raw = F.replace(C("text"), F.lit(". "), F.lit(".\r\n"))
    return d.select("doc_id", F.md5(fn.normalise_breaks(raw)).alias("flat"),
                    F.md5(fn.unify_breaks(raw)).alias("unified"),
                    F.length(fn.strip(F.concat(F.lit("\n\t "), C("text"), F.lit(" \n")))).alias("n"))


BREAKS_SQL = r"""SELECT doc_id,
  md5(replace(replace(replace(raw, chr(13) || chr(10), ' '), chr(13), ' '), chr(10), '  ')) AS flat,
  md5(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS unified,
  CAST(length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS INTEGER) AS n
  FROM (SELECT doc_id, text, replace(text, '. ', '.' || chr(13) || chr(10)) AS raw FROM documents)"""


def truncate_label(spark, sf):
    """Cut labels and placeholder labels."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", fn.truncate_label(C("text")).alias("cut"),
                    fn.blank_label(F.nullif(C("lang"), F.lit("en"))).alias("label"),
                    fn.blank_label(F.when(C("lang") == "de", "").otherwise(C("lang")), "Idioma").alias("prefixed"))


TRUNCATE_SQL = """SELECT doc_id, CASE WHEN length(text) > 45 THEN text[:45] || '...' ELSE text END AS cut,
  COALESCE(NULLIF(NULLIF(lang, 'en'), ''), 'Não Informado') AS label,
  CASE WHEN lang = 'de' THEN 'Idioma Não Informado' ELSE lang END AS prefixed FROM documents"""


def truthy(spark, sf):
    """flags from text."""
    e = table(spark, sf, "events")
    word = F.element_at(F.array(*[F.lit(w) for w in ["true", " SIM ", "0", "s", "no", "", "Yes", "1", "x"]]),
                        (C("event_id") % 9 + 1).cast("int"))
    e = e.withColumns({
        "object": F.try_parse_json(F.expr("concat('{\"v\":', event_id % 3, '}')")),
        "number": F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")})
    return e.select("event_id", fn.truthy_text(word).alias("flag"),
                    fn.truthy_text(F.get_json_object("props", "$.none")).alias("missing"),
                    F.expr(sqltext.truthy_variant("object")).alias("object"),
                    F.expr(sqltext.truthy_variant("number")).alias("number"))


TRUTHY_SQL = """SELECT event_id, (event_id % 9) IN (0, 1, 3, 6, 7) AS flag, FALSE AS missing, TRUE AS object,
  CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0 AS number FROM events"""


def date_casts(spark, sf):
    """strict casts and calendar-day differences on timestamps."""
    e = table(spark, sf, "events")
    return e.select("event_id", fn.strict_date(C("ts")).alias("day"),
                    fn.day_diff(F.lit(AS_OF_EVENTS), C("ts")).alias("days"),
                    fn.day_diff(C("ts") + F.expr("INTERVAL 90 MINUTES"), C("ts")).alias("midnight"))


DATE_SQL = f"""SELECT event_id, CAST(ts AS DATE) AS day,
  CAST(date_diff('day', CAST(ts AS DATE), DATE '{AS_OF_EVENTS}') AS INTEGER) AS days,
  CAST(date_diff('day', ts, ts + INTERVAL 90 MINUTE) AS INTEGER) AS midnight FROM events"""


def day_year_diff(spark, sf):
    """day and year differences."""
    r = requests(spark, sf)
    return r.select("numeroCMCE", fn.day_diff(C("dataCadastro"), C("dataSolicitacao")).alias("days"),
                    fn.year_diff(F.lit(AS_OF).cast("date"), C("dataSolicitacao")).alias("years"))


DIFF_SQL = duck(f"""SELECT numeroCMCE,
  CAST(date_diff('day', CAST(dataSolicitacao AS DATE), CAST(dataCadastro AS DATE)) AS INTEGER) AS days,
  CAST(date_diff('year', CAST(dataSolicitacao AS DATE), {D}) AS INTEGER) AS years FROM v""", v=REQUESTS)


def rounding_cases(spark, sf):
    """both rounding rules."""
    li = table(spark, sf, "lineitem")
    half = C("l_quantity") / 8
    return li.select("l_orderkey", "l_linenumber", fn.sql_round(half, 1).alias("away"),
                     fn.python_round(half, 1).alias("even"),
                     fn.python_round(C("l_extendedprice") / 7, 2).alias("price"))


ROUND_SQL = """SELECT l_orderkey, l_linenumber, ROUND(CAST(l_quantity / 8 AS DOUBLE), 1) AS away,
  CAST(printf('%.1f', l_quantity / 8) AS DOUBLE) AS even,
  CAST(printf('%.2f', l_extendedprice / 7) AS DOUBLE) AS price FROM lineitem"""


def number_format(spark, sf):
    """grouped integers, decimal comma, signed text."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", fn.locale_int((C("c_acctbal") * 1000).cast("bigint")).alias("grouped"),
                    fn.locale_decimal(C("c_acctbal") / 9).alias("comma"),
                    fn.signed_text(C("c_acctbal") / 1000).alias("signed"))


FORMAT_SQL = """SELECT c_custkey,
  replace(format('{:,}', CAST(trunc(c_acctbal * 1000) AS BIGINT)), ',', '.') AS grouped,
  replace(printf('%.1f', c_acctbal / 9), '.', ',') AS comma, printf('%+.1f', c_acctbal / 1000) AS signed
  FROM customer"""


def validators(spark, sf):
    """registration number and state checks."""
    c = table(spark, sf, "customer")
    state = F.concat(F.lit(" "), F.substring("c_mktsegment", 1, 2), F.when(C("c_custkey") % 3 == 0, "1").otherwise(""))
    number = F.when(C("c_custkey") % 4 == 0, None).otherwise(
        F.concat(F.substring("c_name", 10, 9), F.when(C("c_custkey") % 5 == 0, "x").otherwise(" ")))
    return c.select("c_custkey", fn.valid_crm_state(F.lower(state)).alias("state_ok"),
                    fn.valid_crm_number(number).alias("number_ok"))


VALID_SQL = """SELECT c_custkey, c_custkey % 3 <> 0 AS state_ok,
  (c_custkey % 4 <> 0 AND c_custkey % 5 <> 0) AS number_ok FROM customer"""


def rate_bands(spark, sf):
    """bands of the urgent and overdue rates per segment."""
    r = requests_place(spark, sf)
    rates = r.groupBy("usuarioSUS_municipioResidencia_nome").agg(
        fn.ratio(F.count_if(C("entidade_classificacaoRisco_cor") == "VERMELHO"), F.count(F.lit(1)), 1, 100.0)
        .alias("urgent_pct"),
        fn.ratio(F.count_if(C("SLA_Lead_Time_Total_Dias") > 450), F.count(F.lit(1)), 1, 100.0).alias("late_pct"))
    return rates.withColumns({"urgent_band": fn.rate_band(C("urgent_pct"), 15, 30),
                              "late_band": fn.rate_band(C("late_pct"), 10, 25)})


BANDS_SQL = duck("""SELECT *, CASE WHEN urgent_pct < 15 THEN 'low' WHEN urgent_pct <= 30 THEN 'mid' ELSE 'high' END
  AS urgent_band, CASE WHEN late_pct < 10 THEN 'low' WHEN late_pct <= 25 THEN 'mid' ELSE 'high' END AS late_band
FROM (SELECT usuarioSUS_municipioResidencia_nome, CAST(printf('%.1f', CAST(COUNT(*) FILTER
  (WHERE entidade_classificacaoRisco_cor = 'VERMELHO') AS DOUBLE) / COUNT(*) * 100.0) AS DOUBLE) AS urgent_pct,
  CAST(printf('%.1f', CAST(COUNT(*) FILTER (WHERE SLA_Lead_Time_Total_Dias > 450) AS DOUBLE) / COUNT(*) * 100.0)
  AS DOUBLE) AS late_pct FROM v GROUP BY 1)""", v=REQUESTS_PLACE)


QUERIES = {
    "filter_include_exclude": (include_exclude, _where(
        "entidade_classificacaoRisco_cor IN ('VERMELHO','AMARELO') AND SLA_Tipo_Desfecho NOT IN ('POSITIVO')",
        "SLA_Tipo_Desfecho")),
    "filter_tristate": (tristate, _where(
        """((SLA_Desfecho_Atingido = false OR SLA_Desfecho_Atingido IS NULL) AND numeroCMCE % 2 = 0)
        OR (SLA_Desfecho_Atingido = true AND entidade_classificacaoRisco_cor = 'VERDE')""",
        "SLA_Desfecho_Atingido")),
    "filter_presence": (presence, _where(
        """((liminarOrdemJudicial IS NOT NULL AND liminarOrdemJudicial <> '')
         AND (SLA_Tipo_Desfecho IS NULL OR SLA_Tipo_Desfecho = ''))
        OR ((liminarOrdemJudicial IS NULL OR liminarOrdemJudicial = '')
         AND (SLA_Tipo_Desfecho IS NOT NULL AND SLA_Tipo_Desfecho <> ''))""",
        "liminarOrdemJudicial", "SLA_Tipo_Desfecho")),
    "filter_num_range": (num_range, _where(
        """TRY_CAST(entidade_classificacaoRisco_totalPontos AS INTEGER) BETWEEN 100000 AND 200000
        AND TRY_CAST(usuarioSUS_numero AS INTEGER) BETWEEN 10 AND 500""", "usuarioSUS_numero")),
    "filter_date_range": (date_range, _where(
        "CAST(dataSolicitacao AS DATE) BETWEEN '1998-03-01' AND '1998-06-30'", "situacao")),
    "filter_age_range": (age_range, _where(
        f"date_diff('year', TRY_CAST(usuarioSUS_dataNascimento AS DATE), {D}) BETWEEN 18 AND 40",
        "usuarioSUS_dataNascimento")),
    "outcome_filter": (outcome, _where(
        """((SLA_Tipo_Desfecho IS NULL OR SLA_Tipo_Desfecho = '') OR SLA_Tipo_Desfecho IN ('POSITIVO','ABANDONO'))
        AND (SLA_Tipo_Desfecho NOT IN ('ABANDONO'))""", "SLA_Tipo_Desfecho")),
    "outcome_exclude_open": (in_progress_excluded, _where(
        """(SLA_Tipo_Desfecho IS NOT NULL AND SLA_Tipo_Desfecho <> '') AND SLA_Tipo_Desfecho NOT IN ('NEGATIVO')""",
        "SLA_Tipo_Desfecho")),
    "spec_tree": (spec_tree, _where(
        f"""(entidade_classificacaoRisco_cor IN ('VERMELHO','LARANJA','AMARELO')
        AND NOT (date_diff('day', CAST(dataSolicitacao AS DATE), {D}) > 700))
        OR (date_diff('day', CAST(dataSolicitacao AS DATE), {D}) > 2000 AND entidade_classificacaoRisco_cor = 'VERDE')""",
        "dataSolicitacao")),
    "regex_filter": (regex_filter, REGEX_SQL),
    "predicate_rows": (predicate_rows, PREDICATE_SQL),
    "text_any": (text_any, f"SELECT doc_id, lang FROM documents WHERE {_like('%éaux%', '%THAT with%', 'dec%la')}"),
    "text_all": (text_all, f"SELECT doc_id, lang FROM documents WHERE {_like('%Éle%', '%que%aux%', join=' AND ')}"),
    "text_none": (text_none, "SELECT doc_id, lang FROM documents WHERE "
                  + _like('%étion%', '%the%', join=' AND ', negate=True)),
    "text_entity": (text_entity, ENTITY_SQL),
    "accent_fold": (accent_fold, "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents"),
    "secured_view": (secured_view, duck("""SELECT 'known' AS caller, numeroCMCE FROM v
        UNION ALL SELECT 'unknown', numeroCMCE FROM v WHERE 1=0""", v=REQUESTS)),
    "cascading_options": (cascading_options, CASCADE_SQL),
    "custom_sql": (custom_sql, CUSTOM_SQL),
    "valid_key_gate": (valid_key_gate, KEY_SQL),
    "legacy_key_gate": (legacy_key_gate, LEGACY_KEY_SQL),
    "lookup_by_hash": (lookup_by_hash, LOOKUP_SQL),
    "pii_hash": (pii_hash, PII_SQL),
    "epoch_text": (epoch_text, EPOCH_SQL),
    "lenient_cast": (lenient_cast, CAST_SQL),
    "key_format": (key_format, KEY_FORMAT_SQL),
    "age_text": (age_text, AGE_TEXT_SQL),
    "linebreaks": (linebreaks, BREAKS_SQL),
    "truncate_label": (truncate_label, TRUNCATE_SQL),
    "truthy": (truthy, TRUTHY_SQL),
    "date_casts": (date_casts, DATE_SQL),
    "day_year_diff": (day_year_diff, DIFF_SQL),
    "rounding_cases": (rounding_cases, ROUND_SQL),
    "number_format": (number_format, FORMAT_SQL),
    "validators": (validators, VALID_SQL),
    "rate_bands": (rate_bands, BANDS_SQL),
}

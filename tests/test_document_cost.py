"""Plans of the document queries: nothing is parsed twice or without need."""

from pyspark.sql import functions as F

from queuelens.plans import consolidate, flatten, legacy
from queuelens.session import JIT_LIMIT, use_utc
from queuelens.sources import stores


def raw(spark):
    return spark.createDataFrame([("1", '{"numeroCMCE":1,"evolucoes":[]}', "l")],
                                 "protocolo string, conteudo_json string, origem_lista string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_store_rows_parse_a_document_once(spark):
    assert plan(stores.raw_rows(raw(spark))).count(".parseJson(") == 1
    texts = ['{"numeroCMCE":7,"dataAlterouUltimaSituacao":9}', '{"error":"x"}', "null", "no", None, "[1]"]
    df = spark.createDataFrame([(t, "l") for t in texts], "conteudo_json string, origem_lista string")
    rows = {r.conteudo_json: (r.protocolo, r.data_alteracao) for r in stores.raw_rows(df).collect()}
    assert set(rows) == {texts[0], "[1]"} and rows[texts[0]] == ("7", 9) and rows["[1]"][0].startswith(stores.NO_KEY)


def test_actors_parse_no_details(spark):
    flat = flatten.flatten(raw(spark), "2024-01-01", "s")
    assert plan(flat.select("SLA_Atores_Envolvidos")).count("from_json(") == 1


def test_details_start_after_any_white_space(spark):
    texts = [' \t\n\x0b\f\r{"itensEvolucao":[]}', "f{}", "", None, " {}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(F.expr(flatten.parse_details("t")).alias("d")).collect()
    assert [r.d is not None for r in found] == [True, False, False, False, False]


def test_details_behind_the_final_state_are_not_parsed(spark):
    flat = flatten.flatten(raw(spark), "2024-01-01", "s").select("historico_quadro_clinico")
    text = plan(flat)
    assert text.index("from_json(") < text.index("array_position(")  # details are parsed above the cut


def test_retired_layouts_read_their_own_fields_only(spark):
    fields = legacy.parsed_documents(raw(spark)).schema["d"].dataType.fieldNames()
    assert "operador" not in fields and "motivoPendencia" not in fields


def test_usable_rows_list_no_other_errors(spark):
    good, failed = consolidate.convert_raw(raw(spark), "2024-01-01", "s")
    assert "nomeCompleto: missing" not in plan(good.select("numeroCMCE"))
    assert "nomeCompleto: missing" in plan(failed)


def test_wide_projections_stay_compilable(spark):
    use_utc(spark)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == JIT_LIMIT

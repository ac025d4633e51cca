"""Document and event-table forms of the ownership rules against a plain Python fold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from queuelens.operators import contract, history, prefixscan
from queuelens.plans import flatten as fl
from queuelens.states import FINAL_STATES, REGULATOR_STATES, REQUESTER_STATES

C = F.col
DAY = 86_400_000
T0 = 1_700_000_000_000
NOW = "2024-06-01 00:00:00"
NOW_MS = 1717200000000


def document(states, **root):
    events = [{"data": T0 + d * DAY, "situacaoAtual": s, "perfil": None, "usuario": {"nome": f"U{i % 3}"}}
              for i, (s, d) in enumerate(states)]
    return {"numeroCMCE": 123456789012, "situacao": "X", "evolucoes": events, **root}


def flat(spark, docs):
    rows = [(json.dumps(d) if isinstance(d, dict) else d, "lista") for d in docs]
    return fl.flatten(spark.createDataFrame(rows, "conteudo_json string, origem_lista string"), NOW, "s").collect()


@pytest.mark.parametrize("states, expected", [
    ([("AGUARDA_REGULACAO", 0), ("AUTORIZADA", 1), ("AGENDADA", 2), ("REALIZADA", 3)],
     {"SLA_Lead_Time_Total_Dias": 3.0, "SLA_Tipo_Desfecho": "POSITIVO", "SLA_Marco_Autorizada": True,
      "SLA_Marco_Agendada": True, "SLA_Marco_Realizada": True, "SLA_Desfecho_Atingido": True}),
    ([("AGUARDA_REGULACAO", 0), ("CANCELADA", 2)],
     {"SLA_Lead_Time_Total_Dias": 2.0, "SLA_Tipo_Desfecho": "NEGATIVO", "SLA_Marco_Autorizada": False}),
    ([("AGUARDA_REGULACAO", 0), ("ENCERRADA", 1), ("AGENDADA", 2)],
     {"SLA_Lead_Time_Total_Dias": 1.0, "SLA_Tipo_Desfecho": "ABANDONO", "SLA_Marco_Agendada": False}),
    ([("AGUARDA_REGULACAO", 0), ("AGENDADA", 1)],
     {"SLA_Tempo_Regulador_Dias": 1.0, "SLA_Interacoes_Regulacao": 1, "SLA_Marco_Agendada": True,
      "SLA_Desfecho_Atingido": False, "SLA_Tipo_Desfecho": ""}),
    ([("AGUARDA_REGULACAO", 0), ("PENDENTE", 1)],
     {"SLA_Tempo_Regulador_Dias": 1.0, "SLA_Interacoes_Regulacao": 1}),
])
def test_golden_cases(spark, states, expected):
    row = flat(spark, [document(states)])[0].asDict()
    assert {k: row[k] for k in expected} == expected


def test_root_fields_and_empty_history(spark):
    row = flat(spark, [document([], dataSolicitacao=T0, usuarioSUS={"nomeCompleto": "JOAO", "sexo": "M"})])[0]
    assert row.numeroCMCE == "123456789012" and row.origem_lista == "lista"
    assert row.dataSolicitacao == "14/11/2023 22:13:20" and len(row.usuarioSUS_nomeCompleto) == 64
    assert row.SLA_Lead_Time_Total_Dias == 0.0 and row.evolucoes_json == "[]" and row.dataCadastro == ""


def fold(events):
    """Reference fold of (ms, seq, state) tuples in plain Python."""
    owner, last, ms, inter, kind = "SOLICITANTE", None, {"SOLICITANTE": 0, "REGULADOR": 0}, 0, None
    for t, _, state in sorted(events):
        ms[owner] += t - (t if last is None else last)
        last = t
        if state in REGULATOR_STATES:
            owner, inter = "REGULADOR", inter + 1
        elif state in REQUESTER_STATES:
            owner = "SOLICITANTE"
        if state in FINAL_STATES:
            kind = state
            break
    if kind is None:
        ms[owner] += NOW_MS - last
    return (round(ms["SOLICITANTE"] / DAY, 2), round(ms["REGULADOR"] / DAY, 2), inter, kind is not None)


def test_both_forms_match_a_plain_fold(spark):
    rng = random.Random(7)
    states = REGULATOR_STATES + REQUESTER_STATES + ["OUTRO"] * 4 + FINAL_STATES[:1]
    # request 0 holds about a third of all events
    sizes = [150] + [rng.randint(1, 20) for _ in range(30)]
    data = {r: [(T0 + rng.randint(0, 100) * DAY // 7, i, rng.choice(states)) for i in range(n)]
            for r, n in enumerate(sizes)}
    want = {r: fold(e) for r, e in data.items()}
    rows = [(r, t, i, s, "A") for r, e in data.items() for t, i, s in e]
    events = spark.createDataFrame(rows, "request int, ms long, seq int, state string, actor string").withColumn(
        "ts", F.timestamp_millis("ms"))
    fields = ["SLA_Tempo_Solicitante_Dias", "SLA_Tempo_Regulador_Dias", "SLA_Interacoes_Regulacao", "SLA_Desfecho_Atingido"]
    for block in (1_000_000, 4, 1):
        got = {r.request: tuple(r[f] for f in fields) for r in history.ownership(events, NOW, block).collect()}
        assert got == want
    for days, block in ((30, 1_000_000), (0.2, 1_000_000), (5, 3)):
        parts = history.segment_summaries(events, days, block)
        got = {r.request: tuple(r[f] for f in fields) for r in history.ownership_figures(parts, "segment", NOW).collect()}
        assert got == want
    docs = [{"numeroCMCE": r, "situacao": "X", "evolucoes": [
        {"data": t, "situacaoAtual": s} for t, _, s in e]} for r, e in data.items()]
    assert {int(r.numeroCMCE): tuple(r[f] for f in fields) for r in flat(spark, docs)} == want


def test_clinical_texts(spark):
    details = json.dumps({"itensEvolucao": [
        {"codigo": "x", "label": "EVOLUÇÃO", "texto": " melhora\n"}, {"codigo": "nota", "texto": "n"},
        {"label": "Parecer", "texto": "  "}]})
    row = flat(spark, [{"numeroCMCE": 1, "situacao": "X", "evolucoes": [
        {"data": T0, "detalhes": "{broken", "situacaoAtual": "A"},
        {"data": T0 + DAY, "detalhes": details, "situacaoAtual": "B", "operacaoSolicitacao": "OP"}]}])[0]
    assert row.historico_quadro_clinico == "[15/11/2023 22:13:20 | Sistema]: melhora"
    assert row.historico_evolucoes_completo.endswith("-> OP ( ➔ B) | EVOLUÇÃO: melhora | nota: n")
    assert row.dataCadastro == "15/11/2023 22:13:20" and row.medicoSolicitante == "Sistema"


@pytest.mark.parametrize("text, problems", [
    ('{"numeroCMCE": 1, "situacao": "A", "novo": {"x": 1}}', []),
    ('{"numeroCMCE": "12", "situacao": "A"}', []),
    ('{"situacao": "A"}', ["numeroCMCE: missing"]),
    ('{"numeroCMCE": 1.5, "situacao": 3}', ["numeroCMCE: wrong type", "situacao: wrong type"]),
    ('{"numeroCMCE": 1, "situacao": "A", "usuarioSUS": {"cpf": "1"}}', ["usuarioSUS.nomeCompleto: missing"]),
    ('{"numeroCMCE": 1, "situacao": "A", "usuarioSUS": null, "classificacaoRisco": {"totalPontos": "7.5"}}', []),
    ('{"numeroCMCE": 1, "situacao": "A", "evolucoes": {"a": 1}}', ["evolucoes: wrong type"]),
    ('{"numeroCMCE": 1, "situacao": "A", "evolucoes": [{"detalhes": {"a": 1}}]}', ["evolucoes.detalhes: wrong type"]),
    ("[1]", ["document: wrong type"]), ("null", ["payload: corrupt"]), ('{"error": "x"}', ["payload: corrupt"]),
    (None, ["payload: corrupt"])])
def test_document_contract(spark, text, problems):
    df = spark.createDataFrame([(text,)], "conteudo_json string")
    assert contract.with_errors(df).first().errors == problems


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([('{"numeroCMCE": 1, "situacao": "A"}',), ("x",), (None,)], "conteudo_json string")
    good, dead = contract.split_documents(df)
    assert (good.count(), dead.count()) == (1, 2)


def test_running_breaker_matches_a_plain_count(spark):
    rng = random.Random(3)
    flags = [rng.random() < 0.06 for _ in range(500)]
    df = spark.createDataFrame([("r", i, f) for i, f in enumerate(flags)], "run string, seq long, failed boolean")
    errors, opened = 0, None
    for i, f in enumerate(flags):
        errors += f
        if f and opened is None and i + 1 >= 100 and errors / (i + 1) > 0.05:
            opened = i
    row = contract.breaker_verdict(contract.running_breaker(df, block=37)).first()
    assert (row.opened_at, row.total, row.errors) == (opened, 500, sum(flags))


def test_ranks_are_exact_whatever_the_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 5, 5, 5, 9]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o int, i int")
    found = prefixscan.ranked(df, ["k"], ["o"]).collect()
    assert sorted((r.k or "", r.i) for r in found) == sorted((k or "", i) for k, _, i in rows)
    for key in ("a", "b", None):
        part = sorted((r for r in found if r.k == key), key=lambda r: r["rank"])
        assert [r["rank"] for r in part] == list(range(len(part))) and {r.group_rows for r in part} == {len(part)}
        assert [r.o or 0 for r in part] == sorted(r.o or 0 for r in part)
    assert prefixscan.ranked(df.limit(0), ["k"], ["o"]).count() == 0


def test_clustered_numbers_and_dense_days_are_dealt_evenly(spark):
    """Nearly all rows of one run within a sliver of its span; equal times as well."""
    n = 40_000
    seq = F.when(C("id") % 1000 == 0, C("id") * 1_000_000_000).otherwise(C("id"))
    rows = spark.range(n).select(F.lit("r").alias("run"), seq.alias("seq"), (C("id") % 50 == 0).alias("failed"))
    cut = prefixscan.in_pieces(rows, ["run"], ["seq"], block=1000)
    sizes = [r["count"] for r in cut.groupBy("__piece").count().collect()]
    assert len(sizes) == 40 and max(sizes) <= 2 * sorted(sizes)[20] and sum(sizes) == n
    verdict = contract.breaker_verdict(contract.running_breaker(rows, block=1000)).first()
    assert (verdict.total, verdict.errors) == (n, n // 50)
    one_instant = spark.range(n).select(F.lit(1).alias("request"), F.lit(5).alias("ms"), F.lit(None).cast("int").alias("seq"))
    sizes = [r["count"] for r in prefixscan.in_pieces(one_instant, ["request"], ["ms", "seq"], 1000).groupBy("__piece").count().collect()]
    assert len(sizes) == 40 and set(sizes) == {1000}
    placed = prefixscan.ranked(rows, ["run"], ["seq"], partitions=8).groupBy(F.floor(C("rank") / 5000)).count().collect()
    assert len(placed) == 8


def test_broadcast_keys_stay_within_their_bound(spark):
    df = spark.range(300).select((C("id") % 30).alias("k"), C("id").alias("o"))
    cut = prefixscan.in_pieces(df, ["k"], ["o"], block=2, most_heavy=10)  # block grows to 16, then no key is large
    assert cut.count() == 300 and {r["count"] for r in cut.groupBy("k", "__piece").count().collect()} == {10}

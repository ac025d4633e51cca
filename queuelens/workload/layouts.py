"""Reports over bucketed and clustered tables; the SQL is that of the plain tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import predicates as p
from ..plans import distribution, reports
from ..session import scratch_dir
from ..sources import layout
from .analytics import FUNNEL_SQL, P90_SQL
from .filters import ENTITY_SQL
from .records import AS_OF
from .views import REQUESTS_PLACE, request_lines, requests, requests_place, table

C = F.col


def _bucketed(df, name, key=layout.REQUEST_KEY, buckets=8):
    return layout.write_bucketed(df, f"{name}_{uuid.uuid4().hex}", key=key, buckets=buckets)


def bucketed_p90(spark, sf):
    """P90 of waits per request; the requests are grouped without a shuffle."""
    lines = _bucketed(request_lines(spark, sf).select("numeroCMCE", "dataSolicitacao", "dataCadastro"), "lines")
    w = distribution.waits(lines, None, AS_OF)
    return w.agg(F.percentile("dias_fila", 0.9).alias("p90_lead_time"), F.percentile("dias_esquecido", 0.9).alias("p90_esquecido"))


def bucketed_funnel(spark, sf):
    """Stage counts; the flags per request need no shuffle."""
    return reports.funnel(_bucketed(requests(spark, sf), "requests"), F.col("SLA_Lead_Time_Total_Dias") > 50)


def bucketed_entity(spark, sf):
    """Conversations by their turns; grouping and semi-join need no shuffle."""
    turns = _bucketed(table(spark, sf, "conversations"), "turns", key="conv_id")
    return p.entity_text(turns, "conv_id", "text", any_terms="mentré, oneth", all_terms="er", no_terms="quezal").select(
        "conv_id", "turn", "role")


def clustered_range(spark, sf):
    """Thirty days of one list from a table clustered by date and list."""
    path = scratch_dir(spark, "clustered")
    layout.write_clustered(requests_place(spark, sf), path, files=8, row_group_mb=0.125)
    rows = spark.read.parquet(path)
    return rows.filter((C("dataSolicitacao") >= F.lit("1996-03-01").cast("timestamp"))
                       & (C("dataSolicitacao") < F.lit("1996-03-31").cast("timestamp"))
                       & (C("origem_lista") == "BUILDING")).select("numeroCMCE", "origem_lista", "usuarioSUS_municipioResidencia_nome")


QUERIES = {
    "bucketed_p90": (bucketed_p90, P90_SQL),
    "bucketed_funnel": (bucketed_funnel, FUNNEL_SQL),
    "bucketed_entity": (bucketed_entity, ENTITY_SQL),
    "clustered_range": (clustered_range, f"""SELECT "numeroCMCE", origem_lista, "usuarioSUS_municipioResidencia_nome"
        FROM ({REQUESTS_PLACE}) WHERE "dataSolicitacao" >= TIMESTAMP '1996-03-01' AND "dataSolicitacao" < TIMESTAMP '1996-03-31'
        AND origem_lista = 'BUILDING'"""),
}

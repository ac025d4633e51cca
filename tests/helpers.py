"""What several test modules share."""

import json


def doc(key, state="A", **more):
    return json.dumps({"numeroCMCE": key, "situacao": state, "evolucoes": [], **more})


def land(spark, path, docs):
    spark.createDataFrame([(d, "fila") for d in docs], "conteudo_json string, origem_lista string") \
        .coalesce(1).write.mode("append").json(path)


def stage_totals(spark, run):
    """(result, input bytes, shuffled bytes) of the jobs that ``run`` starts."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        context.listenerBus().waitUntilEmpty()
        none = gateway.new_array(gateway.jvm.double, 0)
        listed = context.statusStore().stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
        every = [listed.apply(i) for i in range(listed.size())]
        return {(s.stageId(), s.attemptId()): (s.inputBytes(), s.shuffleWriteBytes()) for s in every}
    before = stages()
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")  # reads of other threads are not counted
    try:
        out = run()
    finally:
        spark.conf.unset("parquet.hadoop.vectored.io.enabled")
    new = [v for k, v in stages().items() if k not in before]
    return out, sum(v[0] for v in new), sum(v[1] for v in new)

"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


#: Bytes of a method that HotSpot still compiles (DontCompileHugeMethods).
JIT_LIMIT = "8000"


def build_session(app: str = "queuelens", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on (UTC dates, adaptive plans)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
        .config("spark.ui.enabled", "false")
        # no call-site capture per Column call; it triples the time to build wide plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Day arithmetic and epoch formatting depend on the session zone; pin it. Methods of whole-stage code that the JVM
    would never compile (projections of a hundred columns) give way to the split code of single operators."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") != JIT_LIMIT:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    A session inside one process may do without that setting and gets a local folder. On a
    cluster every executor would write to a disk of its own, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="queuelens-")
    return f"{base}/{label}-{uuid.uuid4().hex}"

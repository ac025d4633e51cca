"""Document ingest: landing folder to raw store, request table, dead letters and run log.

A run is one call of ``ingest``: it takes in what lies in the landing folder, in one or more
micro-batches, and leaves one row in the run log. Documents of a list whose first full sync
has ended are cut at the list's watermark, the highest change stamp that was published before
the run. The circuit breaker counts over the whole run.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.contract import ContractError, breaker_open, with_errors
from ..operators.dedup import incremental_cut, latest_per_key
from ..plans.flatten import canonical, flatten, typed
from ..rules import DEFAULT_RULES, Rules
from ..schema import REQUEST_COLUMNS, REQUEST_SCHEMA
from ..sources import stores
from ..sources.files import write_parquet
from ..sources.runs import KeyedStore
from .run import drain

LANDING_SCHEMA = "conteudo_json STRING, origem_lista STRING"
MARKS_SCHEMA = "origem_lista STRING, watermark BIGINT"
SYNC_SCHEMA = "origem_lista STRING, run_id STRING"
STORED_REQUEST = T.StructType([*REQUEST_SCHEMA.fields, T.StructField("data_alteracao", T.LongType())])
STARTED = "the run did not end"


@dataclass(frozen=True)
class IngestPaths:
    """Datasets below one base folder."""

    base: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.base}/{name}"


def request_store(paths: IngestPaths) -> KeyedStore:
    """Published request versions; its manifest knows the highest stamp per list."""
    return KeyedStore(paths.requests, STORED_REQUEST, ("numeroCMCE",), newest=("data_alteracao", "batch_id"),
                      group="origem_lista", stamp="data_alteracao")


def raw_store(paths: IngestPaths) -> KeyedStore:
    """Captured documents, newest batch first."""
    return KeyedStore(paths.raw, stores.RAW_SCHEMA, ("protocolo",))


@dataclass
class Run:
    """Counters of one run; they grow with every micro-batch."""

    marks: DataFrame
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    start: float = field(default_factory=time.time)
    total: int = 0
    failed: int = 0
    ingested: int = 0
    bytes: int = 0
    lists: set[str] = field(default_factory=set)
    opened: bool = False

    def log(self, spark: SparkSession, paths: IngestPaths, status: str, message: str = "") -> None:
        stores.log_run(spark, paths.runs, self.run_id, self.start, time.time() - self.start, status,
                       self.ingested, self.failed, self.bytes, sorted(self.lists), message)


def landing_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Captured documents as JSON lines ``{conteudo_json, origem_lista}`` with their place in
    the source; a page of the source is a file, ``max_files`` bounds how many make one
    micro-batch."""
    reader = spark.readStream.schema(LANDING_SCHEMA)
    lines = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)
    return lines.select("conteudo_json", "origem_lista", F.struct(
        "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("file"))


def _prime_above(n: int) -> int:
    n += 1
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def _staged(batch: DataFrame, marks: DataFrame) -> DataFrame:
    """A batch with errors, key, stamp, place, ``storable`` and ``taken``: good and not below the watermark.

    The rows are dealt out by the key they are stored by before the checks: files that cannot be split do not bound the
    number of tasks, and both stores find their newest rows without moving the texts again. Where the files themselves
    are parts of a hash by key, as another Spark job leaves them, a few files would fill just as few of the same number
    of parts; over a prime number they fill all.
    """
    parts = _prime_above(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = (batch.withColumn("place", F.struct("file", F.monotonically_increasing_id().alias("row")))
             .withColumn("head", F.expr(stores.head_of("conteudo_json")))
             .select("conteudo_json", "origem_lista", "place", F.col("head.key"), F.col("head.stamp").alias("data_alteracao"),
                     "head.storable", stores.stored_key(F.col("head.key"), F.col("conteudo_json")).alias("protocolo"))
             .repartition(parts, "protocolo"))
    cut = incremental_cut(with_errors(dealt).withColumn("taken", F.size("errors") == 0), marks, mark_only="old")
    return cut.withColumn("taken", F.col("taken") & ~F.col("old")).drop("old")


def publish(batch: DataFrame, batch_id: int, run: Run, paths: IngestPaths, as_of, salt: str,
            rules: Rules = DEFAULT_RULES) -> None:
    """One micro-batch: raw rows, breaker, request rows, dead letters.

    Every write replaces the output of an earlier try of the same batch and has one row per
    key: the one with the highest change stamp, of equal or missing stamps the last in the
    source. When the breaker opens, the raw rows stay, nothing else of the batch is
    published and the run stops.
    """
    newest = [F.desc("data_alteracao"), F.desc("place")]
    staged = _staged(batch, run.marks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        figures = staged.agg(
            F.count(F.lit(1)).alias("total"), F.count_if(F.size("errors") > 0).alias("failed"),
            F.count_if("taken").alias("taken"),
            F.coalesce(F.sum(F.octet_length("conteudo_json")), F.lit(0)).alias("bytes"),
            F.collect_set("origem_lista").alias("lists")).first()
        run.total += figures.total
        run.failed += figures.failed
        run.bytes += figures.bytes
        run.lists |= set(figures.lists)
        raw = staged.filter("storable").withColumn("data_captura", F.current_timestamp())
        raw_store(paths).append(latest_per_key(raw, "protocolo", newest), batch_id)
        if breaker_open(run.failed, run.total, rules):
            run.opened = True
            raise ContractError(f"{run.failed} of {run.total} documents failed")
        good = latest_per_key(staged.filter("taken"), "protocolo", newest)  # a good document is stored by its key
        flat = flatten(good, as_of, salt, keep=("data_alteracao",))
        request_store(paths).append(typed(canonical(flat, [*REQUEST_COLUMNS, "data_alteracao"]), keep=("data_alteracao",)),
                                    batch_id)
        stores.append_batch(staged.filter(F.size("errors") > 0)
                            .select(F.col("conteudo_json").alias("raw"), "errors", "origem_lista"),
                            paths.dead_letters, batch_id)
        run.ingested += figures.taken
    finally:
        staged.unpersist()


def ingest(spark: SparkSession, landing: str, paths: IngestPaths, as_of, salt: str,
           rules: Rules = DEFAULT_RULES, max_files: int | None = None,
           checkpoint: str | None = None) -> str:
    """Take in everything that is in the landing folder now; returns the run's id.

    The run's audit row is written when it starts and replaced when it ends: SUCCESS, PARTIAL
    (some documents failed), CIRCUIT_BREAKER or FAILURE, the last two with the error's text
    and followed by the error. A batch on which the breaker opened is tried again by the
    next run; to get past it, mend the landing files or pass rules with a higher
    ``breaker_ratio``. A run that ends well completes the full sync of its lists.
    """
    run = Run(_marks(spark, paths))
    run.log(spark, paths, stores.FAILURE, STARTED)
    try:
        drain(landing_stream(spark, landing, max_files),
              lambda batch, n: publish(batch, n, run, paths, as_of, salt, rules),
              checkpoint=checkpoint or f"{paths.base}/checkpoint")
    except Exception as error:
        message = f"{run.failed} of {run.total} documents failed" if run.opened else str(error)
        run.log(spark, paths, stores.run_status(run.failed, run.opened, message), message)
        raise
    synced = spark.createDataFrame([(name, run.run_id) for name in run.lists if name is not None], SYNC_SCHEMA)
    (synced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
     .parquet(paths.full_syncs))
    run.log(spark, paths, stores.run_status(run.failed))
    return run.run_id


def _marks(spark: SparkSession, paths: IngestPaths) -> DataFrame:
    """Watermarks of the lists with a full sync as they stand now, kept apart from the store."""
    path = f"{paths.marks}/{uuid.uuid4().hex}"
    write_parquet(resume_state(spark, paths).filter("full_sync_completed").select("origem_lista", "watermark"), path)
    return spark.read.schema(MARKS_SCHEMA).parquet(path)


def current_requests(spark: SparkSession, paths: IngestPaths, keys: DataFrame | None = None) -> DataFrame:
    """The request table: newest version per key, by change stamp and then by batch; of some ``keys`` (a frame with
    ``numeroCMCE``) without reading the others' pages."""
    return request_store(paths).current(spark, keys).drop("batch_id", "data_alteracao")


def maintain(spark: SparkSession, paths: IngestPaths, most_runs: int = 4) -> None:
    """Merge small runs of the stores; run it between two runs of the ingest."""
    request_store(paths).compact(spark, most_runs)
    raw_store(paths).compact(spark, most_runs)


def dead_letters(spark: SparkSession, paths: IngestPaths) -> DataFrame:
    return stores.read_store(spark, paths.dead_letters, stores.DEAD_SCHEMA)


def resume_state(spark: SparkSession, paths: IngestPaths) -> DataFrame:
    """Per list: highest published change stamp, last batch, and whether a run over it has ended well.

    Read from the manifest of the request store; no data file is opened. Raw rows of a batch that the breaker refused do
    not count, or the next run would cut them.
    """
    done = (stores.read_store(spark, paths.full_syncs, SYNC_SCHEMA).select("origem_lista").distinct()
            .withColumn("done", F.lit(True)))
    marks = request_store(paths).figures(spark).select(
        F.col("grp").alias("origem_lista"), F.col("max_stamp").alias("watermark"), "last_batch")
    return (marks.join(done, "origem_lista", "left")
            .select("origem_lista", "watermark", "last_batch", F.coalesce("done", F.lit(False)).alias("full_sync_completed")))

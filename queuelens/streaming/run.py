"""Starting streams that drain their source and stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import scratch_dir


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append",
          checkpoint: str | None = None) -> None:
    """Run all data that is there now through ``handle(batch, batch_id)``.

    The checkpoint keeps offsets and state, so a job that lost its driver goes on where the
    last finished batch ended.
    """
    where = checkpoint or scratch_dir(stream.sparkSession, "checkpoint")
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", where)
             .trigger(availableNow=True).foreachBatch(handle).start())
    query.awaitTermination()


def to_table(stream: DataFrame, path: str, mode: str = "complete", checkpoint: str | None = None) -> None:
    """Write a stream's result: each batch replaces it (complete) or adds its own part."""
    def write(batch: DataFrame, batch_id: int) -> None:
        target = path if mode == "complete" else f"{path}/part={batch_id}"
        batch.write.mode("overwrite").parquet(target)
    drain(stream, write, mode, checkpoint)

"""Structured Streaming preparation (STR1, STR2).

The source behaviour is a stateless map over a stream of rows: ``stream_map``,
in append mode with the file sink's own exactly-once log.  Packing, and encoding
against a vocabulary too large for a map, regroup rows, so each micro-batch runs
the batch operators in ``foreachBatch``, writing each micro-batch to a
folder of its own with overwrite, so that a replayed batch replaces itself.
Packing drops the remainder per micro-batch, as the source does.  Runs are
``Trigger.AvailableNow`` with a checkpoint under the shared checkpoint
directory, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..sinks.writers import scratch_path


def run_available_now(stream: DataFrame, per_batch: Callable[[DataFrame, int], DataFrame], out_path: str,
                      checkpoint: str) -> None:
    """Apply ``per_batch`` to every micro-batch; its result is the parquet folder ``batch=<epoch>``."""

    def sink(batch: DataFrame, epoch: int) -> None:
        per_batch(batch, epoch).write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_file_source(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over a directory; a path naming one ``.<fmt>`` file is read as its folder
    filtered to that name (string rule, so it works on any file system)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    head, _, name = path.rstrip("/").rpartition("/")
    if name.endswith(f".{fmt}") and head:
        r = r.option("pathGlobFilter", name)
        path = head
    return r.load(path)


def stream_map(spark: SparkSession, source_path: str, schema, transform: Callable[[DataFrame], DataFrame], out_path: str,
               checkpoint: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> None:
    """STR1: the files that arrived since ``checkpoint``, mapped row by row and appended to ``out_path``; a restart with
    the same checkpoint goes on where the stream stopped, and the sink's log keeps replayed batches out."""
    stream = transform(stream_file_source(spark, source_path, schema, fmt, max_files_per_trigger))
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", out_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_transform(spark: SparkSession, source_path: str, schema, per_batch, name: str,
                     fmt: str = "parquet", max_files_per_trigger: int | None = None,
                     arrivals: Iterable = (None,)) -> DataFrame:
    """STR1 / STR2 driver: stream the files, transform each micro-batch, return the sink as a table with the number of
    each row's ``batch``.  The stream is taken up again after each of ``arrivals``, whose iteration may bring files."""
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    for _ in arrivals:
        run_available_now(stream_file_source(spark, source_path, schema, fmt, max_files_per_trigger), per_batch, out, ckpt)
    return spark.read.parquet(out)

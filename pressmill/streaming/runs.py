"""Structured Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pressmill.functions import fixed
from pressmill.operators.dedup import skip_processed
from pressmill.operators.events import due_again, exhausted
from pressmill.operators.stats import windowed_traffic

#: Parts of a batch for each core, so that a part of long rows holds up little.
PARTS = 3


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all there is, write Parquet, and return the table written so far."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drop_repeats(stream: DataFrame, at: str, key: str = "id", within: str = "24 hours") -> DataFrame:
    """Drop events whose id came before, for as long as the watermark keeps it."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def idle_sessions(stream: DataFrame, at: str, *keys: str, gap_seconds: int = fixed.IDLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Activity sessions; ``idle_from`` is when the gap has passed."""
    out = (
        stream.withWatermark(at, late)
        .groupBy(F.session_window(at, f"{gap_seconds} seconds").alias("s"), *keys)
        .agg(F.count("*").alias("events"))
    )
    return out.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("idle_from"), "events")


def live_traffic(stream: DataFrame, at: str, *keys: str, late: str = "10 minutes", **kwargs) -> DataFrame:
    return windowed_traffic(stream.withWatermark(at, late), at, *keys, **kwargs)


class StopRequested(Exception):
    """A control row asked the job to stop; the batch at hand was not started."""


def stop_status(control: DataFrame, job_id: str) -> str | None:
    """``paused`` or ``cancelled`` when the latest control row of the job says so."""
    row = control.filter(F.col("job_id") == job_id).agg(F.max_by("status", "ledger_seq")).first()
    return row[0] if row and row[0] in ("paused", "cancelled") else None


def run_controlled(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    control: Callable[[], DataFrame],
    job_id: str,
) -> str:
    """Run ``handle`` per micro-batch until the input is used up or a control row stops the job.

    The check comes before a batch; a stopped batch is not committed, so a later run with the
    same checkpoint goes on with it.  Returns ``completed``, ``paused`` or ``cancelled``.
    """
    stopped: list[str] = []

    def step(batch: DataFrame, number: int) -> None:
        asked = stop_status(control(), job_id)
        if asked:
            stopped.append(asked)
            raise StopRequested(asked)
        handle(batch, number)

    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except Exception:
        if not stopped:
            raise
    return stopped[0] if stopped else "completed"


def spread(batch: DataFrame) -> DataFrame:
    """``batch`` in a few parts for each core, where it came in fewer, as a batch of a few files does."""
    parts = PARTS * batch.sparkSession.sparkContext.defaultParallelism
    return batch if batch.rdd.getNumPartitions() >= parts else batch.repartition(parts)


def append_once(
    spark: SparkSession, process: Callable[[DataFrame], DataFrame], path: str, keys: tuple[str, ...]
) -> Callable[[DataFrame, int], None]:
    """A batch handler that skips keys already written and writes each batch to its own folder.

    A batch that runs again after a failure replaces its own folder, so nothing appears twice.
    """

    def handle(batch: DataFrame, number: int) -> None:
        fresh = batch = spread(batch)
        earlier = _written_before(spark, path, keys, batch.schema, number)
        if earlier is not None:
            fresh = skip_processed(batch, earlier, keys)
        process(fresh).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def _written_before(
    spark: SparkSession, path: str, keys: tuple[str, ...], schema: T.StructType, number: int
) -> DataFrame | None:
    if number == 0:
        return None
    kept = T.StructType([f for f in schema.fields if f.name in keys])
    done = spark.read.schema(kept.add("batch", T.LongType())).parquet(path)
    return done.filter(F.col("batch") < number).select(*keys)


def split_failures(retry_path: str, dead_path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler: deliveries due again go to one table, dead letters to another."""

    def handle(batch: DataFrame, number: int) -> None:
        due_again(batch).write.mode("overwrite").parquet(f"{retry_path}/batch={number}")
        exhausted(batch).write.mode("overwrite").parquet(f"{dead_path}/batch={number}")

    return handle


def start_cleaning(
    lines: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "10 seconds"
) -> StreamingQuery:
    """Keep cleaning new lines as they arrive."""
    return (
        lines.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )


def recent(stream: DataFrame, at: str, as_of: Column, hours: int) -> DataFrame:
    from pressmill.operators.events import backlog

    return backlog(stream, at, as_of, hours)

"""Streams of job and review events, folded as they arrive.  An extension of the batch replay.

Each micro-batch's events are appended to the log of their keys and folded again
from the log, so the stream's result equals the batch result over all events,
whatever the batches were, and a batch that runs twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_replay(events: DataFrame, log: str, fold: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of events to ``log`` (idempotent by batch), which ``fold`` reads; returns the running query."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def state(spark: SparkSession, log: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The state after all batches so far."""
    return fold(spark.read.option("basePath", log).parquet(log).drop("batch"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Event counts by type and window with a watermark; works on streams and on tables."""
    from pyspark.sql import functions as F

    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n")

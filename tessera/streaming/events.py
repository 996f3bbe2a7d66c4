"""Structured Streaming: windows over events, and incremental enrichment of chunks (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) of event-time windows; `late` sets a watermark on a stream."""
    source = events.withWatermark("ts", late) if late else events
    return source.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, n) of sessions that end after `gap` without an event."""
    source = events.withWatermark("ts", late) if late else events
    return source.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def enrich(chunks: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Adds work() of each chunk of a stream once (by id, within the watermark) to a table; stops at the stream's end.

    A batch's rows lie in a folder of its own, path/batch=N, which a batch that is done again replaces.
    """
    fresh = chunks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    return fresh.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")).start()

"""Sessions by idle time, in batch and as a stream, and buckets of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

GAP = "30 minutes"


def event_sessions(events: DataFrame, gap: str = GAP, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n, total) of each run of events with less than ``gap`` between them.

    On a stream give ``late``: how long events may be late; a session is told once it is that old.
    """
    rows = events if late is None else events.withWatermark("ts", late)
    found = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per hour and type of event."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def write(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, appended as Parquet; a later run goes on from the checkpoint."""
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Sessions of timed tokens or events on a stream: the batch gap rules with event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, key: str = "timeline_id", time: str = "ts", gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """Count and bounds of each key's sessions; a session closes after ``gap`` without
    an event, and the watermark drops its state. Works on batches alike."""
    marked = stream.withWatermark(time, late)
    out = marked.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return out.select(key, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n_events")

"""The canonical stream record, and how the events table becomes one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a stream record. Times are microseconds here; operators only need one unit throughout.
UNIT = "stream_id long, stream_kind string, pts long, sequence long, key_frame boolean, bytes long"


def from_events(events: DataFrame) -> DataFrame:
    """events (event_id, ts, user_id, event_type, value) as stream records."""
    return events.select(
        F.col("user_id").alias("stream_id"),
        F.col("event_type").alias("stream_kind"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("pts"),
        F.col("event_id").alias("sequence"),
        (F.col("event_type") == "purchase").alias("key_frame"),
        F.round(F.col("value") * 100).cast("long").alias("bytes"),
    )

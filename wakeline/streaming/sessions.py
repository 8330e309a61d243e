"""Gap sessions on batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "30 minutes"


def gap_sessions(positions: DataFrame, gap: str = GAP, late: str | None = "1 hour") -> DataFrame:
    """Runs of messages with silences of at most ``gap``, per vessel.

    On a stream ``late`` bounds the state: a session is emitted once the
    watermark has passed it.
    """
    rows = positions.withColumn("at", F.timestamp_seconds("timestamp_sec"))
    if late is not None and rows.isStreaming:
        rows = rows.withWatermark("at", late)
    # a session closes one gap after its last message; a second more keeps a gap of exactly the limit inside
    window = F.session_window("at", F.lit(gap))
    sessions = rows.groupBy("vessel_id_int", window.alias("session")).agg(
        F.count(F.lit(1)).alias("points"), F.max("timestamp_sec").alias("end_sec"))
    return sessions.select(
        "vessel_id_int", F.unix_seconds("session.start").alias("start_sec"), "end_sec", "points")

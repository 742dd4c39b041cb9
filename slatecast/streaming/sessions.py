"""Sessions of detections that are still coming in.

A stream has no rows before and after, so types are kept apart here: a session is a run of rows of one video and type with
no gap of more than so many frames. Frames count as time since the video's start; a row later than the watermark is
dropped, as its session is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def open_sessions(detections: DataFrame, max_gap: int = 25, fps: float = 25.0, late_seconds: float = 10.0) -> DataFrame:
    """``(video_id, text_type, first_frame, last_frame, n, text, confidence, pixel_count)`` of each session, for streams and tables.

    The text is that of the most confident row; of equals that with most pixels, then the earliest.
    """
    at = F.timestamp_micros((F.col("frame_number") * (1_000_000 / fps)).cast("long"))
    # a window ends its gap after its last row and holds no row at its end, so a gap of max_gap needs a little more
    gap = f"{int((max_gap + 0.5) * 1_000_000 / fps)} microseconds"
    timed = detections.withColumn("_at", at).withWatermark("_at", f"{int(late_seconds * 1000)} milliseconds")
    best = F.max_by(F.struct("text", "confidence", "pixel_count"), F.struct("confidence", "pixel_count", -F.col("frame_number")))
    grouped = timed.groupBy("video_id", "text_type", F.session_window("_at", gap)).agg(F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"), F.count(F.lit(1)).alias("n"), best.alias("best"))
    return grouped.select("video_id", "text_type", "first_frame", "last_frame", "n", "best.*")

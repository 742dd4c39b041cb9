"""Post-processing of raw detections: confidence, sessions, merging, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatecast.functions.timecode import frame_to_smpte
from slatecast.operators.detections import confident
from slatecast.operators.sessions import continuous_sessions, merge_similar
from slatecast.params import DEFAULT, Params
from slatecast.sources.files import written


def postprocess(detections: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Detections as the result table has them, with ``timecode`` and in ``leader`` order."""
    # written, as merging reads them twice
    sessions = written(continuous_sessions(confident(detections, params.min_confidence), params.max_gap, params))
    # sessions are listed by where they begin, which their group's name, the first row's rid, tells
    merged = merge_similar(sessions, params, order="group_id")
    return merged.withColumn("timecode", frame_to_smpte(F.col("frame_number"), params.fps)).orderBy("video_id", "leader")

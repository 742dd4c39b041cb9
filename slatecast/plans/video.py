"""From a video to raw detections."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatecast.functions.text import normalized
from slatecast.functions.timecode import frame_to_smpte
from slatecast.operators.detections import one_colour
from slatecast.operators.ocr import Engine, assembled, mock_engine, recognized
from slatecast.operators.pixels import images_enhanced
from slatecast.operators.trigger import triggered
from slatecast.params import DEFAULT, Params
from slatecast.sources.files import written
from slatecast.sources.frames import counts_of, frames_at, hits_of, open_decoder, read_frames, regions_of
from slatecast.sources.images import with_png

Lut = np.ndarray | list[np.ndarray] | None


def _answers(images: DataFrame, make_engine: Callable[[], Engine], lut: Lut) -> DataFrame:
    """What the engine reads of regions, which it gets as PNG images, in the task that cut them out."""
    if lut is not None:
        images = images_enhanced(images, lut)
    return recognized(with_png(images), make_engine)


def detect(spark: SparkSession, path: str, make_engine: Callable[[], Engine] = mock_engine, params: Params = DEFAULT, lut: Lut = None, **options: object) -> DataFrame:
    """Raw detections of a video: frames, coloured regions, sampling, recognition, assembly.

    All frames are decoded once, for counts, which are written; sampling decides on those. The chosen frames alone are
    then read again, in seek order, and what is cut out of them is recognised in the same task: no pixel is shuffled. A
    colour table ``lut`` is applied to the chosen regions.
    """
    counts = written(counts_of(read_frames(spark, path, **options), params))
    places = {k: v for k, v in options.items() if k not in ("start_frame", "end_frame", "inclusive")}
    frames = frames_at(one_colour(counts).drop("video_id"), path, most=None, **places)
    read = assembled(_answers(regions_of(frames, params), make_engine, lut))
    return read.select("video_id", "rid", "frame_number", "text_type", "pixel_count", "confidence", "text", *[F.col(f"bbox.{c}") for c in ("x1", "y1", "x2", "y2")])


def detect_legacy(spark: SparkSession, path: str, make_engine: Callable[[], Engine] = mock_engine, params: Params = DEFAULT, lut: Lut = None, **options: object) -> DataFrame:
    """Detections the older way: both ends of the range included, regions unmasked, all items of an answer, the older trigger and labels.

    As the trigger depends on what was read before, every hit is recognised, in parallel and in one decoding; the answers
    are written, and the trigger is folded over whether there was any text.
    """
    fps = open_decoder({"path": path} | {k: str(v) for k, v in options.items()}).fps
    hits = hits_of(read_frames(spark, path, inclusive=True, **options), params, masked=False)
    keys = ["video_id", "text_type", "frame_number"]
    answers = written(_answers(hits, make_engine, lut))
    read = assembled(answers, all_items=True)
    read = read.select(*keys, "confidence", normalized(F.col("text"), F.col("text_type"), legacy=True).alias("text")).where(F.trim("text") != "")
    rows = answers.select(*keys, "pixel_count").join(read, keys, "left").withColumn("readable", F.col("text").isNotNull())
    return triggered(rows, fps, readable="readable").where("readable").drop("readable").withColumn("timecode", frame_to_smpte(F.col("frame_number"), fps))

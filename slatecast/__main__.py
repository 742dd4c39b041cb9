"""``python -m slatecast -v VIDEO``: detections of a video as a CSV file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from slatecast.functions.timecode import time_to_frame
from slatecast.operators.detections import statistics
from slatecast.operators.ocr import installed_engine
from slatecast.plans.postprocess import postprocess
from slatecast.plans.video import detect, detect_legacy
from slatecast.sources.files import detections_name, read_cube, write_detections_csv
from slatecast.sources.frames import open_decoder


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="slatecast", description=__doc__)
    parser.add_argument("-v", "--video_path", required=True)
    parser.add_argument("-l", "--lut", "--lut_path", help="a .cube file for the regions before recognition")
    parser.add_argument("-s", "--start", "--start_time", default="", help="time code of the first frame")
    parser.add_argument("-e", "--end", "--end_time", default="", help="time code of the frame after the last")
    parser.add_argument("-o", "--output", help="the file of results; named after the video if not given")
    parser.add_argument("--sequential", action="store_true", help="read the frames in one task")
    parser.add_argument("--legacy", action="store_true", help="the older trigger, labels and regions, with no post-processing")
    parser.add_argument("option", nargs="*", help="options of the decoder, as name=value")
    given = parser.parse_args(arguments)
    options = dict(x.split("=", 1) for x in given.option)
    spark = SparkSession.builder.appName("slatecast").getOrCreate()
    try:
        video = open_decoder({"path": given.video_path} | options)
        for name, code in (("start_frame", given.start), ("end_frame", given.end)):
            if code:
                options[name] = spark.range(1).select(time_to_frame(F.lit(code), video.fps, strict=True).alias("f")).first()["f"]
        if given.sequential:
            options["frames_per_partition"] = max(video.frame_count, 1)
        output = given.output or detections_name(given.video_path, given.legacy)
        lut = read_cube(spark, given.lut) if given.lut else None
        if given.legacy:
            print(write_detections_csv(detect_legacy(spark, given.video_path, installed_engine, lut=lut, **options).orderBy("frame_number", F.desc("text_type")), output))
            return 0
        raw = detect(spark, given.video_path, installed_engine, lut=lut, **options).cache()
        print(write_detections_csv(postprocess(raw), output))
        print(statistics(raw).first().asDict())
    except Exception as error:  # noqa: BLE001  the command's way to say that it failed
        print(f"failed: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from slatecast.params import Params
from slatecast.plans import views
from slatecast.plans.postprocess import postprocess
from slatecast.streaming import anchored

TABLES = "/root/testdata/sf0.001"
SCHEMA = "video_id string, rid long, frame_number long, text_type string, pixel_count long, confidence double, text string, x1 int, y1 int, x2 int, y2 int"


def run(spark, folder, batches, late_seconds=2.0, params=Params()):
    """The rows that come out of batches of rows, and the query."""
    for rows in batches:
        seen = set(Path(folder, "in").glob("*.parquet"))
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for new in set(Path(folder, "in").glob("*.parquet")) - seen:  # files are read in the order of their times
            os.utime(new, (1_700_000_000 + 10 * len(seen),) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = anchored.postprocessed(stream, params, late_seconds)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.parquet(f"{folder}/out").collect(), query


def far(spark, videos):
    """A row a video far ahead, that moves the watermark over all before."""
    return spark.createDataFrame([(v, 10**9 + k, 10**7, "VFX", 700, 0.9, "end", 0, 0, 1, 1) for k, v in enumerate(videos)], SCHEMA)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_same_rows_as_the_table(spark, tmp_path):
    table = views.detections(spark, TABLES).drop("k").select(*[c.split()[0] for c in SCHEMA.split(", ")]).withColumn("pixel_count", F.col("pixel_count").cast("long")).cache()
    want = {(r["video_id"], r["rid"], r["frame_number"], r["text"], r["leader"]) for r in postprocess(table).collect()}
    assert len(want) > 20
    # batches overlap in time: within each stretch of frames every other row comes a batch later
    stretch = F.floor(F.col("rid") / 100) + (F.col("rid") % 2 == 1).cast("int")
    batches = [table.where(stretch == k) for k in range(12)]
    got, query = run(spark, str(tmp_path), [*batches, far(spark, [f"v{k}" for k in range(7)])], late_seconds=40.0)
    assert {(r["video_id"], r["rid"], r["frame_number"], r["text"], r["leader"]) for r in got} == want and len(got) == len(want)
    assert anchored.late_rows(query) == 0


def test_sessions_close_by_the_clock_and_late_rows_are_counted(spark, tmp_path):
    params = Params(min_rows=2)

    def rows(*frames, text="VFX:shot", video="v"):
        return spark.createDataFrame([(video, f, f, "VFX", 700, 0.5 + f / 10_000, text, 0, 0, 10, 10) for f in frames], SCHEMA)

    first = [rows(0, 4, 8), rows(500, 504), rows(600, 604), rows(2, 6)]
    got, query = run(spark, str(tmp_path), first, params=params)
    # the first session is out when the watermark is beyond all that could join its group; the others wait
    assert [(r["frame_number"], r["rid"], r["leader"]) for r in got] == [(0, 0, 0), (500, 500, 500)]
    assert anchored.late_rows(query) == 2
    # the query goes on from its state
    got, _ = run(spark, str(tmp_path), [rows(2000)], params=params)
    assert sorted((r["frame_number"], r["rid"]) for r in got) == [(0, 0), (500, 500), (600, 600)]


def test_near_sessions_merge(spark, tmp_path):
    """Two sessions alike and within 25 frames are one; a type's change parts them."""
    rows = [("v", f, f, "VFX", 700, 0.5, "VFX:one shot", 0, 0, 10, 10) for f in (0, 2, 4)]
    rows += [("v", f, f, "DI", 700, 0.6, "DI:other", 0, 0, 10, 10) for f in (6, 8)]
    rows += [("v", f, f, "VFX", 800, 0.9, "VFX:one shot", 50, 50, 60, 60) for f in (10, 12)]
    got, _ = run(spark, str(tmp_path), [spark.createDataFrame(rows, SCHEMA), far(spark, ["v"])], params=Params(min_rows=2))
    assert sorted((r["leader"], r["rid"], r["frame_number"], r["text_type"]) for r in got) == [(0, 10, 10, "VFX"), (6, 6, 6, "DI")]

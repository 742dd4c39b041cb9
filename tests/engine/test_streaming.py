from slatecast.streaming.sessions import open_sessions

SCHEMA = "video_id string, text_type string, frame_number long, text string, confidence double, pixel_count int"
ROWS = [("v", "VFX", f, f"t{f}", 0.5 + (f == 30) / 10, 700) for f in (0, 10, 30, 55, 81, 90)] + [("v", "DI", 20, "d", 0.5, 700), ("w", "VFX", 10, "w", 0.5, 1)]
WANT = {("v", "VFX", 0, 55, 4, "t30"), ("v", "VFX", 81, 90, 2, "t81"), ("v", "DI", 20, 20, 1, "d"), ("w", "VFX", 10, 10, 1, "w")}


def test_table(spark):
    assert {tuple(r)[:6] for r in open_sessions(spark.createDataFrame(ROWS, SCHEMA)).collect()} == WANT


def test_stream(spark, tmp_path):
    end = [("v", "VFX", 10**6, "end", 0.1, 1)]  # moves the watermark, so that all before it comes out
    for k, rows in enumerate((ROWS[:3], ROWS[3:], end)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = open_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r)[:6] for r in spark.table("sessions").collect()} == WANT

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatecast.plans import video
from slatecast.sources import frames, images
from slatecast.sources.frames import FrameReader, _decoded, frames_at, read_frames, regions_of, stream_frames

OPTIONS = {"width": 4, "height": 2, "video_id": "clip"}


@pytest.fixture
def clip(tmp_path):
    path = tmp_path / "clip.raw"
    path.write_bytes(b"".join(bytes([k]) * 24 for k in range(100)))
    return str(path)


@pytest.mark.parametrize(
    ("condition", "want", "tasks"),
    [
        ("frame_number BETWEEN 35 AND 44", range(35, 45), 1),
        ("frame_number > 35 AND frame_number < 57", range(36, 57), 3),
        ("frame_number >= 90", range(90, 100), 1),
        ("frame_number = 7 AND video_id = 'clip'", [7], 1),
        ("frame_number IN (8, 21)", [8, 21], 2),
        ("frame_number = 7 AND video_id = 'other'", [], 1),
        ("frame_number < 5 AND frame_number > 7", [], 1),
        ("frame_number % 50 = 3", [3, 53], 10),
        ("frame_number > 35 OR height = 3", range(36, 100), 10),
    ],
)
def test_conditions_choose_what_is_read(spark, clip, condition, want, tasks):
    found = read_frames(spark, clip, frames_per_partition=10, **OPTIONS).where(condition)
    assert sorted(r["frame_number"] for r in found.collect()) == list(want)
    assert found.rdd.getNumPartitions() == tasks


def test_what_is_pushed_is_not_tested_again(spark, clip):
    plan = read_frames(spark, clip, **OPTIONS).where("frame_number > 3 AND frame_number <= 9")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


def test_ranges_of_options_and_conditions_meet():
    reader = FrameReader({"path": "x", "decoder": "slatecast.sources.synthetic.SyntheticDecoder", "start_frame": "100", "end_frame": "200", "frames_per_partition": "30"})
    left = list(reader.pushFilters([frames.GreaterThan(("frame_number",), 150), frames.LessThan(("frame_number",), 500), frames.EqualTo(("height",), 2)]))
    assert [type(x).__name__ for x in left] == ["EqualTo"]
    assert [(p.start, p.end) for p in reader.partitions()] == [(151, 181), (181, 200)]


def test_frames_that_a_table_names(spark, clip):
    rng = np.random.default_rng(2)
    wanted = [(int(x), k) for k, x in enumerate(rng.integers(-5, 120, 300))]
    table = spark.createDataFrame(wanted, "frame_number long, n int").repartition(7)
    got = frames_at(table, clip, block=9, **OPTIONS).collect()
    assert sorted((r["frame_number"], r["n"]) for r in got) == sorted(x for x in wanted if 0 <= x[0] < 100)
    assert all(r["data"] == bytes([r["frame_number"]]) * 24 and r["video_id"] == "clip" for r in got)


def test_a_stream_loses_and_repeats_nothing(spark, tmp_path):
    """The file grows, the query is stopped and started from its checkpoint, and half a frame waits for its rest."""
    path, done, state = tmp_path / "live.raw", str(tmp_path / "done"), str(tmp_path / "state")

    def grow(first, last, more=b""):
        with open(path, "ab") as file:
            file.write(b"".join(bytes([k]) * 24 for k in range(first, last)) + more)

    def run():
        numbers = stream_frames(spark, str(path), frames_per_partition=4, **OPTIONS).select("frame_number", F.substring("data", 1, 1).alias("first"))
        query = numbers.writeStream.format("parquet").option("path", done).option("checkpointLocation", state).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r["frame_number"], r["first"][0]) for r in spark.read.parquet(done).collect())

    grow(0, 10, b"half")
    assert run() == [(k, k) for k in range(10)]
    with open(path, "r+b") as file:
        file.truncate(240)
    grow(10, 25)
    assert run() == [(k, k) for k in range(25)]
    assert run() == [(k, k) for k in range(25)]


def test_regions_are_those_of_one_decoding(spark):
    found = read_frames(spark, "synthetic", decoder="slatecast.sources.synthetic.SyntheticDecoder", end_frame=150)
    want = {(r["frame_number"], r["text_type"]): r["image_bytes"] for r in frames.hits_of(found).collect()}
    counts = frames.counts_of(found)
    assert {(r["frame_number"], r["text_type"]) for r in counts.collect()} == want.keys()
    chosen = frames_at(counts.drop("video_id"), "synthetic", decoder="slatecast.sources.synthetic.SyntheticDecoder")
    assert {(r["frame_number"], r["text_type"]): r["image_bytes"] for r in regions_of(chosen).collect()} == want


def test_no_pixels_are_shuffled(spark):
    made = video.detect(spark, "synthetic", decoder="slatecast.sources.synthetic.SyntheticDecoder", end_frame=200)
    plan = made._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and "BatchScan" not in plan and not any("image_bytes" in line or "data#" in line for line in exchanges)


def test_two_videos_write_two_files(spark, tmp_path):
    shape = "video_id string, frame_number long, text_type string, image_bytes binary"
    rows = spark.createDataFrame([(f"/cut/{v}/a b.mov", 1, "VFX", v.encode()) for v in ("x", "y")], shape)
    written = images.write_images(rows, str(tmp_path / "out")).collect()
    assert len({r["path"] for r in written}) == 2 and all(r["path"].endswith("/roi_1_VFX.png") for r in written)
    assert sorted(p.read_bytes() for p in (tmp_path / "out").rglob("*.png")) == [b"x", b"y"]
    assert not list((tmp_path / "out").rglob("*.half"))


def test_a_crowded_block_goes_to_several_tasks_and_small_frames_go_on_together(spark, joins_turn_into_broadcasts, tmp_path):
    pixels = np.random.default_rng(3).integers(0, 256, (8, 2, 2, 3), dtype=np.uint8)
    path = str(tmp_path / "small.raw")
    pixels.tofile(path)
    wanted = spark.range(400).select((F.col("id") % 9).alias("frame_number"), F.col("id").alias("rid"))
    got = frames_at(wanted, path, most=20, width=2, height=2)
    rows = got.select("rid", "frame_number", "data", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["rid"], bytes(r["data"])) for r in rows) == [(k, pixels[k % 9].tobytes()) for k in range(400) if k % 9 < 8]
    assert len({r["task"] for r in rows}) > 1
    batches = frames_at(wanted, path, most=None, width=2, height=2).mapInArrow(lambda x: (b.select(["rid"]).slice(0, 1) for b in x), "rid long")
    assert batches.count() == 1
    assert [b.num_rows for b in _decoded({"path": path, "width": "2", "height": "2"}, range(20))] == [8]

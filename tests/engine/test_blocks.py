"""Operators that work block by block, or on packed frames, give what a loop over all gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatecast.operators import detections as d
from slatecast.operators import pixels

HITS = "video_id string, rid long, frame_number long, text_type string, pixel_count int"


def made_up(seed):
    rng = random.Random(seed)
    rows = []
    for video in ("v", "w"):
        rows += [(video, 2 * f + k, f, kind, 700) for f in range(150) for k, kind in enumerate(("VFX", "DI")) if rng.random() < 0.6]
    return rows


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_sampling_in_blocks(spark, block):
    rows = made_up(block)
    want = []
    for video in ("v", "w"):
        counter = {"VFX": 0, "DI": 0}
        for f in range(150):
            for _, rid, _, kind, _ in sorted((h for h in rows if h[0] == video and h[2] == f), key=lambda h: h[3] != "VFX"):
                counter[kind] += 1
                if counter[kind] % 2 == 1:
                    want.append((video, rid))
                    break
    hits = spark.createDataFrame(rows, HITS).repartition(5)
    got = d.one_colour(hits, block)
    assert got.columns == hits.columns and sorted((r["video_id"], r["rid"]) for r in got.collect()) == sorted(want)
    nth, other = {}, []
    for video, rid, _, kind, _ in rows:
        nth[video, kind] = nth.get((video, kind), 0) + 1
        if nth[video, kind] % 2 == 1:
            other.append((video, rid))
    assert sorted((r["video_id"], r["rid"]) for r in d.every_other(hits, block).collect()) == sorted(other)


def test_sampling_needs_no_task_for_a_whole_video(spark):
    """Rows are windowed by blocks; only the blocks' maps are by video."""
    plan = d.one_colour(spark.createDataFrame(made_up(1), HITS).repartition(2))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and all("_block" in line for line in windows)
    assert sum("frame_number" not in line for line in windows) == 2  # of the maps, a row a block


@pytest.mark.parametrize(("height", "width"), [(1, 1), (3, 3), (5, 31), (6, 32), (7, 33), (9, 100)])
def test_openings_of_packed_masks(spark, height, width):
    rng = np.random.default_rng(height * 1000 + width)
    masks = {(v, f): rng.random((2, height, width)) < 0.75 for v in ("a", "b") for f in range(3)}
    rows = [(v, f, y, x, bool(m[0, y, x]), bool(m[1, y, x])) for (v, f), m in masks.items() for y in range(height) for x in range(width)]
    table = spark.createDataFrame(rows, "video_id string, frame_number long, y int, x int, p boolean, q boolean").repartition(3)
    got = {(r["video_id"], r["frame_number"]): (r["p"], r["q"]) for r in pixels.opened_counts(table, {"p": F.col("p"), "q": F.col("q")}).collect()}
    assert got == {key: tuple(int(pixels.frame_opened(m[k]).sum()) for k in (0, 1)) for key, m in masks.items()}


def test_one_exchange_for_both_colours(spark):
    table = spark.createDataFrame([("v", 1, 0, 0, 1, 2, 3)], "video_id string, frame_number long, y int, x int, b int, g int, r int").repartition(2)
    plan = pixels.coloured_counts(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_nulls_in_a_colour_table(spark):
    table = np.stack(np.meshgrid(*[np.array([0.0, 1.0])] * 3, indexing="ij"), axis=-1)
    rows = spark.createDataFrame([(10, 20, 30), (None, 1, 2)], "b int, g int, r int")
    got = [tuple(r) for r in pixels.lut_enhanced(rows, table).collect()]
    assert got[1] == (None, None, None) and max(abs(a - b) for a, b in zip(got[0], (10, 20, 30), strict=True)) <= 1

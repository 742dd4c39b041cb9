import random

import pytest

from slatecast.operators.trigger import triggered

SCHEMA = "video_id string, frame_number long, text_type string, pixel_count int, readable boolean"


def loop(rows, fps=25.0):
    """One pass over each video and type, hit by hit."""
    want = []
    for key in sorted({(r[0], r[2]) for r in rows}):
        seen = last_frame = last_count = 0
        for video, frame, kind, count, works in sorted(r for r in rows if (r[0], r[2]) == key):
            seen += 1
            waited = frame - last_frame
            if seen >= 5 and waited >= 25 and (waited >= int(10 * fps) or abs(count - last_count) > 0.3 * last_count):
                want.append((video, frame, kind))
                if works:
                    last_frame, last_count = frame, count
    return sorted(want)


@pytest.mark.parametrize(("seed", "density", "works", "gap"), [(1, 0.5, 0.7, 0), (2, 0.05, 0.3, 0), (3, 0.9, 1.0, 3000), (4, 0.01, 0.5, 900), (5, 0.4, 0.02, 0)])
def test_blocks_give_what_a_loop_gives(spark, seed, density, works, gap):
    rng = random.Random(seed)
    rows = []
    for video in ("v", "w"):
        for kind in ("VFX", "DI"):
            frame = rng.randint(0, 40)
            while frame < 4000:
                if rng.random() < density:
                    rows.append((video, frame, kind, rng.choice([0, 700, 720, 800, 1500]), rng.random() < works))
                frame += gap if gap and rng.random() < 0.002 else 1
    hits = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for block in (250, 700, 4096):
        got = triggered(hits, readable="readable", block=block)
        assert sorted((r["video_id"], r["frame_number"], r["text_type"]) for r in got.collect()) == loop(rows), block
    assert got.columns == hits.columns


def test_blocks_stay_whole_where_their_states_are_broadcast(spark, joins_turn_into_broadcasts):
    rng = random.Random(6)
    rows = [("v", frame, kind, rng.choice([700, 720, 800, 1500]), rng.random() < 0.7) for kind in ("VFX", "DI") for frame in range(12000) if rng.random() < 0.8]
    got = triggered(spark.createDataFrame(rows, SCHEMA).repartition(8), readable="readable", block=1000)
    assert sorted((r["video_id"], r["frame_number"], r["text_type"]) for r in got.collect()) == loop(rows)


def test_always_readable_and_no_hits(spark):
    rows = [("v", 30 * k, "DI", 700 + 400 * (k % 2), None) for k in range(40)]
    got = triggered(spark.createDataFrame(rows, SCHEMA), block=250).collect()
    assert sorted(r["frame_number"] for r in got) == [f for _, f, _ in loop([(*r[:4], True) for r in rows])]
    assert triggered(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame(rows[:4], SCHEMA)
    assert triggered(few).count() == 0 and triggered(few, readable="readable").count() == 0

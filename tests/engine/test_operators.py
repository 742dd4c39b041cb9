import random
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatecast.operators import detections as d
from slatecast.operators import markers as m
from slatecast.operators import ocr, pixels, sessions, trigger
from slatecast.params import Params
from slatecast.sources import editor, files, images
from slatecast.sources.frames import frames_at, hits_of, open_decoder, read_frames, video_info

SCHEMA = "video_id string, rid long, frame_number long, text_type string, pixel_count int, confidence double, text string, x1 int, y1 int, x2 int, y2 int"


def made_up(seed, n=160):
    """Runs with ties, equal confidences, interleaved types, empty boxes and values at the thresholds."""
    rng = random.Random(seed)
    rows, frame = [], 0
    box, text = (0, 0, 10, 10), "abcde"
    for k in range(n):
        frame += rng.choice([0, 1, 1, 2, 12, 13, 25, 26, 40]) if rng.random() < 0.4 else 1
        if rng.random() < 0.15:
            box = rng.choice([(0, 0, 10, 10), (0, 0, 10, 8), (1, 0, 11, 10), (0, 0, 0, 0), (50, 50, 60, 60)])
        if rng.random() < 0.2:
            text = rng.choice(["abcde", "abcd", "abcdf", "xyz", "AB cde", "  "])
        rows.append((f"v{seed % 2}", k, frame, "DI" if rng.random() < 0.1 else "VFX", rng.choice([680, 681, 900]), rng.choice([0.5, 0.505, 0.51, 0.9]), text, *box))
    return rows


def loop_groups(rows, gap=12, iou=0.8, same=0.8):
    out, group = {}, []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if group:
            first, last = group[0], group[-1]
            near = sessions.overlap(first[7:], r[7:]) >= iou or sessions.alike(frozenset(last[6].lower()), frozenset(r[6].lower())) >= same
            if r[2] - last[2] > gap or r[3] != last[3] or not near:
                group = []
        group.append(r)
        out[r[1]] = group[0][1]
    return out


def loop_leaders(rows):
    out, used = {}, set()
    for i, a in enumerate(rows):
        if i in used:
            continue
        for j in range(i, len(rows)):
            b = rows[j]
            if j not in used and (j == i or (a[3] == b[3] and abs(a[2] - b[2]) <= 25 and sessions.alike(frozenset(a[6].lower()), frozenset(b[6].lower())) > 0.8)):
                used.add(j)
                out[b[1]] = a[1]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_sessions_and_merging_against_loops(spark, seed):
    rows = made_up(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["rid"]: r["group_id"] for r in sessions.anchored_groups(df, 12).collect()} == loop_groups(rows)
    assert {r["rid"]: r["leader"] for r in sessions.merged_groups(df).collect()} == loop_leaders(rows)
    counts = {}
    for g in loop_groups(rows).values():
        counts[g] = counts.get(g, 0) + 1
    got = sessions.continuous_sessions(df, 12).collect()
    assert sorted(r["group_id"] for r in got) == sorted(g for g, n in counts.items() if n >= 10)


def test_sampling_against_a_loop(spark):
    rng = random.Random(9)
    hits = [("v", 2 * f + k, f, kind, 700) for f in range(60) for k, kind in enumerate(("VFX", "DI")) if rng.random() < 0.6]
    counter, want = {"VFX": 0, "DI": 0}, []
    for f in range(60):
        for _, rid, _, kind, _ in sorted((h for h in hits if h[2] == f), key=lambda h: h[3] != "VFX"):
            counter[kind] += 1
            if counter[kind] % 2 == 1:
                want.append(rid)
                break
    df = spark.createDataFrame(hits, "video_id string, rid long, frame_number long, text_type string, pixel_count int")
    assert sorted(r["rid"] for r in d.one_colour(df).collect()) == want


def test_trigger_against_a_loop(spark):
    rng = random.Random(5)
    rows = [("v", f, "VFX", rng.choice([700, 800, 1500]), rng.random() < 0.7) for f in range(3, 900) if rng.random() < 0.5]
    want, since, last, seen = [], 0, 0, 0
    by_frame = {r[1]: r for r in rows}
    for f in range(900):
        if r := by_frame.get(f):
            seen += 1
            if seen >= 5 and since >= 25 and (since >= 250 or abs(r[3] - last) > last * 0.3):
                want.append(f)
                if r[4]:
                    last, since = r[3], 0
        since += 1
    df = spark.createDataFrame(rows, "video_id string, frame_number long, text_type string, pixel_count int, readable boolean")
    assert [r["frame_number"] for r in trigger.triggered(df, readable="readable").orderBy("frame_number").collect()] == want and want


def test_statistics_of_nothing(spark):
    row = d.statistics(spark.createDataFrame([], SCHEMA)).first()
    assert tuple(row) == (0, 0, 0, 0.0, "N/A")
    nan = spark.createDataFrame([("v", 1, 1, "VFX", 1, float("nan"), "VFX:a", 0, 0, 0, 0), ("v", 2, 1, "VFX", 1, 0.1, "", 0, 0, 0, 0)], SCHEMA)
    assert [r["rid"] for r in d.confident(nan).collect()] == [1]


def test_kernels_agree_with_expressions(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    rows = [("v", 0, y, x, *map(int, image[y, x])) for y in range(9) for x in range(7)]
    df = spark.createDataFrame(rows, "video_id string, frame_number long, y int, x int, b int, g int, r int")
    colours = pixels.frame_hls(image)
    assert all((r["h"], r["l"], r["s"]) == tuple(colours[r["y"], r["x"]]) for r in pixels.with_hls(df).collect())
    mask = image[..., 1] > 70
    clean = pixels.frame_opened(mask)
    got = pixels.opened(df.withColumn("mask", (F.col("g") > 70).cast("int"))).collect()
    assert all(bool(r["mask"]) == clean[r["y"], r["x"]] for r in got) and 0 < clean.sum() < mask.sum()
    table = rng.random((3, 3, 3, 3))
    flat = pixels.frame_lut(image, table)
    assert all(max(abs(int(flat[r["y"], r["x"], k]) - r[c]) for k, c in enumerate("bgr")) <= 1 for r in pixels.lut_enhanced(df, table).collect())


def test_engine_failures_are_kept_apart(spark):
    def make():
        def engine(number, image):
            if number == 2:
                raise RuntimeError("no")
            return [{"rec_texts": [" a", "  ", "", None, "b"], "rec_scores": [0.5, 0.7, 0.1, 0.1, 0.9], "rec_polys": [np.array([[1, 1], [4, 1], [4, 3], [1, 3]])]}] if number else None

        return engine

    df = spark.createDataFrame([(k, b"") for k in range(4)], "frame_number long, image_bytes binary")
    read = ocr.recognized(df, make)
    assert {r["frame_number"]: r["failed"] for r in read.collect()} == {0: False, 1: False, 2: True, 3: False}
    row = ocr.assembled(read).where("frame_number = 3").first()
    assert row["text"] == "ab" and row["confidence"] == pytest.approx(0.7) and tuple(row["bbox"]) == (1, 1, 4, 3)
    assert ocr.assembled(read).count() == 2


def test_frames_from_a_raw_file(spark, tmp_path):
    frames = np.random.default_rng(1).integers(0, 256, (10, 4, 6, 3), dtype=np.uint8)
    path = tmp_path / "clip.raw"
    path.write_bytes(frames.tobytes() + b"cut")
    options = {"width": 6, "height": 4, "video_id": "clip"}
    got = read_frames(spark, str(path), start_frame=2, end_frame=9, frames_per_partition=3, **options).orderBy("frame_number").collect()
    assert [r["frame_number"] for r in got] == list(range(2, 9)) and got[0]["data"] == frames[2].tobytes()
    assert read_frames(spark, str(path), end_frame=4, inclusive=True, **options).count() == 5
    wanted = spark.createDataFrame([(8, "a"), (1, "b"), (77, "c"), (8, "d"), (None, "e"), (-1, "f")], "frame_number long, data string")
    assert sorted(r["frame_number"] for r in frames_at(wanted, str(path), block=4, **options).collect()) == [1, 8, 8]
    assert tuple(video_info(spark, str(path), **options).first())[1:] == (25.0, 10, 6, 4, 0.4)
    assert hits_of(read_frames(spark, str(path), **options), Params(min_pixels=10**6)).count() == 0


def test_video_from_frames_to_rows(spark):
    from slatecast.plans.postprocess import postprocess
    from slatecast.plans.video import detect

    rows = postprocess(detect(spark, "synthetic", decoder="slatecast.sources.synthetic.SyntheticDecoder", end_frame=400)).collect()
    assert rows and {r["text_type"] for r in rows} <= {"VFX", "DI"} and all(r["text"].startswith(r["text_type"] + ":") for r in rows)


def test_marker_files(spark, tmp_path):
    path = tmp_path / "markers.csv"
    path.write_text('﻿f,t,note,p,c,type\r\n10,x,"a ""b""\nc",1,2,VFX\r\n 20.5 ,x,note,1,2,DI\r\nbad,x,n,1,2,DI\r\n1,2\r\n12d,x,n,1,2,\r\n30,x,n,1,2,\r\n40,x,n,1,2,DI,more,fields\r\n', encoding="utf-8")
    rows = files.read_marker_csv(spark, str(path))
    assert tuple(m.import_stats(rows).first()) == (4, 2, 6)
    got = {r["frame_id"]: (r["color"], r["name"], r["note"]) for r in rows.where("ok").collect()}
    assert got == {10.0: ("Green", "VFX", 'a "b"\nc'), 20.5: ("Yellow", "DI", "note"), 30.0: ("Blue", "", "n"), 40.0: ("Yellow", "DI", "n")}
    assert tuple(m.import_stats(files.read_marker_csv(spark, str(tmp_path / "none.csv"))).first()) == (0, 0, 0)
    out = tmp_path / "markers.json"
    files.write_marker_json(m.stored(rows.where("ok")), str(out))
    assert files.read_marker_json(spark, str(out)).count() == 4 and '"frame_range": {' in out.read_text()
    files.write_marker_json(m.stored(rows.limit(0)), str(out))
    assert '"frame_range": null' in out.read_text()


def test_marker_store(spark):
    raw = spark.createDataFrame([("t", 5, "Blue", None, None, None, None, 1), ("t", 5, "Red", "n", "x", 2.0, "c", 2), ("t", 1, None, None, None, None, None, 3)], "timeline_id string, frame_id int, color string, name string, note string, duration double, custom_data string, at int")
    store = m.stored(raw, "at")
    assert [tuple(r)[1:] for r in m.in_order(store).collect()] == [(1.0, "", "", "", 1.0, ""), (5.0, "Red", "n", "x", 2.0, "c")]
    new = spark.createDataFrame([("t", 5.0, "GREEN", "", "", 1.0, ""), ("t", 6.0, "DI", "", "", 1.0, "")], store.schema)
    kept, refused = m.added(store, new)
    assert sorted((r["frame_id"], r["color"]) for r in kept.collect()) == [(1.0, ""), (5.0, "Red"), (6.0, "DI")] and refused.first()["color"] == "Green"


def test_detections_file(spark, tmp_path):
    rows = spark.createDataFrame([(4, "00:00:00:04", 'a,"b"', 700, 0.8125, "VFX"), (5, "00:00:00:05", "灯", 800, 0.0025, "DI")], "frame_number long, timecode string, text string, pixel_count int, confidence double, text_type string")
    path = files.write_detections_csv(rows.orderBy("frame_number"), str(tmp_path / "out.csv"))
    raw = open(path, "rb").read()  # noqa: SIM115
    assert raw.startswith(b"\xef\xbb\xbf") and raw.decode("utf-8-sig").split("\r\n") == ["帧数,时间码,文本内容,像素数量,置信度,类型", '4,00:00:00:04,"a,""b""",700,0.812,VFX', "5,00:00:00:05,灯,800,0.003,DI", ""]


def test_cube_file(spark, tmp_path):
    path = tmp_path / "a.cube"
    path.write_text("# made up\nTITLE x\nLUT_3D_SIZE 2\n" + "".join(f"{r} {g} {b}\n" for b in (0, 1) for g in (0, 1) for r in (0, 1)))
    table = files.read_cube(spark, str(path))
    assert all(table[r, g, b].tolist() == [r, g, b] for r in (0, 1) for g in (0, 1) for b in (0, 1))
    cube = "".join(f"{r} {g} {b}\n" for b in (0, 1) for g in (0, 1) for r in (0, 1))
    for wrong in ("", "LUT_1D_SIZE 1\n0 0 0\n", "LUT_3D_SIZE 2\n0 0 0\n", "LUT_1D_SIZE 2\n0 0\n1 1\n", "LUT_3D_SIZE 2\nDOMAIN_MAX 2 2 2\n" + cube):
        with pytest.raises(ValueError):
            files.parse_cube(wrong)


def test_tables_of_one_dimension_and_shapers(spark):
    one = files.parse_cube("DOMAIN_MIN 0 0 0\nLUT_1D_SIZE 3\n0 0 1\n0.25 0.5 0.5\n1 1 0\n")
    rng = np.random.default_rng(4)
    frame = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    value = frame[..., ::-1].astype(np.float32) / 255
    want = np.stack([np.interp(value[..., k], [0, 0.5, 1], one[:, k]) for k in range(3)], axis=-1)
    assert np.abs(pixels.frame_lut(frame, one).astype(int) - (want * 255).astype(int)[..., ::-1]).max() <= 1
    pixel_rows = spark.createDataFrame([(y, x, *map(int, frame[y, x])) for y in range(5) for x in range(7)], "y int, x int, b int, g int, r int")
    got = {(r["y"], r["x"]): (r["b"], r["g"], r["r"]) for r in pixels.lut_enhanced(pixel_rows, one).collect()}
    assert all(abs(a - int(b)) <= 1 for (y, x), v in got.items() for a, b in zip(v, pixels.frame_lut(frame, one)[y, x], strict=True))
    cube = "".join(f"{1 - r} {g} {b}\n" for b in (0, 1) for g in (0, 1) for r in (0, 1))
    both = files.parse_cube("LUT_1D_SIZE 2\nLUT_1D_INPUT_RANGE 0 1\nLUT_3D_SIZE 2\n0 0 0\n0.5 1 1\n" + cube)
    made = pixels.frame_lut(np.array([[[10, 20, 255]]], np.uint8), both)[0, 0].tolist()
    assert abs(made[0] - 10) <= 1 and abs(made[1] - 20) <= 1 and abs(made[2] - 127) <= 1


def test_png_images(spark, tmp_path):
    rng = np.random.default_rng(5)
    for shape in ((1, 1, 3), (3, 5, 3), (40, 17, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert np.array_equal(images.decode_png(images.encode_png(image)), image)
    for wrong in (np.zeros((0, 4, 3), np.uint8), np.zeros((4, 4), np.uint8), np.zeros((2, 2, 3))):
        with pytest.raises(ValueError):
            images.encode_png(wrong)
    with pytest.raises(ValueError):
        images.decode_png(b"GIF89a")
    rows = [(1, "VFX", image.tobytes(), (40, 17, 3)), (2, "DI", b"cut", (40, 17, 3)), (3, "DI", None, None)]
    df = spark.createDataFrame(rows, "frame_number long, text_type string, image_bytes binary, image_shape struct<h:int,w:int,c:int>")
    done = images.with_png(df)
    assert [r["frame_number"] for r in done.collect()] == [1]  # what cannot be encoded goes
    (written,) = images.write_images(done, str(tmp_path / "made")).collect()
    assert written["path"].endswith("roi_1_VFX.png") and written["n_bytes"] == (tmp_path / "made" / "roi_1_VFX.png").stat().st_size


class FakeVideo:
    """As much of a container reader as the decoder asks of it: 10 frames, each of its number."""

    def __init__(self, path):
        self.at, self.good, self.seeks = 0, path.startswith("clip"), 0

    def isOpened(self):
        return self.good

    def get(self, what):
        return {5: 0.0, 7: 10, 3: 4, 4: 2}[what]

    def set(self, what, value):
        self.at, self.seeks = value, self.seeks + 1

    def read(self):
        self.at += 1
        return (True, np.full((2, 4, 3), self.at - 1, np.uint8)) if self.at <= 10 else (False, None)


def test_containers(monkeypatch):
    with pytest.raises(RuntimeError, match="cv2"):
        monkeypatch.setitem(sys.modules, "cv2", None)
        open_decoder({"path": "clip.MP4"})
    fake = types.SimpleNamespace(VideoCapture=FakeVideo, CAP_PROP_FPS=5, CAP_PROP_FRAME_COUNT=7, CAP_PROP_FRAME_WIDTH=3, CAP_PROP_FRAME_HEIGHT=4, CAP_PROP_POS_FRAMES=1)
    monkeypatch.setitem(sys.modules, "cv2", fake)
    video = open_decoder({"path": "clip.MP4"})
    assert (video.fps, video.frame_count, video.width, video.height) == (25.0, 10, 4, 2)
    assert [video.read(k)[0] for k in (0, 1, 2)] == [0, 1, 2] and video.video.seeks == 0
    assert video.read(7)[0] == 7 and video.read(8)[0] == 8 and video.video.seeks == 1
    assert video.read(10) is None
    with pytest.raises(OSError):
        open_decoder({"path": "none.mov"})


def test_editor_timelines(spark):
    line = editor.MemoryTimeline()
    new = spark.createDataFrame([("t0", 5.0, "Green", "VFX", "a", 1.0, ""), ("t0", 9.0, "Blue", "x", "b", 2.0, "c"), ("t0", 5.0, "Red", "y", "d", 1.0, "")], editor.RAW)
    assert editor.write_timeline(new, line) == (2, 1)
    line.held[7.0] = {"color": "Red"}
    got = {r["frame_id"]: r for r in editor.read_timeline(spark, line).collect()}
    assert sorted(got) == [5.0, 7.0, 9.0] and got[7.0]["note"] == "" and got[7.0]["duration"] == 1.0 and got[9.0]["custom_data"] == "c"
    assert line.DeleteMarkerAtFrame(7.0) and not line.DeleteMarkerAtFrame(7.0)
    assert editor.read_timeline(spark, editor.MemoryTimeline()).count() == 0
    with pytest.raises(ConnectionError, match="could not be read"):
        editor.read_timeline(spark, None)
    project = types.SimpleNamespace(GetName=lambda: "p", GetCurrentTimeline=lambda: line, GetMediaPool=lambda: None)
    link = editor.Connection(types.SimpleNamespace(GetProjectManager=lambda: types.SimpleNamespace(GetCurrentProject=lambda: project)))
    assert link.project_name == "p" and link.timeline is line
    with pytest.raises(ConnectionError, match="media pool"):
        _ = link.media_pool
    with pytest.raises(ConnectionError, match="scripting access"):
        editor.Connection(None)


def test_older_way_of_reading(spark):
    """The trigger's rows, with what was read there; regions are whole."""
    from slatecast.plans.video import detect_legacy

    rows = detect_legacy(spark, "synthetic", decoder="slatecast.sources.synthetic.SyntheticDecoder", end_frame=400).orderBy("text_type", "frame_number").collect()
    assert rows and all(r["text"].strip() for r in rows)
    frames = read_frames(spark, "synthetic", decoder="slatecast.sources.synthetic.SyntheticDecoder", end_frame=3)
    whole, masked = (hits_of(frames, masked=m).orderBy("frame_number", "text_type").collect() for m in (False, True))
    assert [r["pixel_count"] for r in whole] == [r["pixel_count"] for r in masked]
    assert all(bytes((40, 40, 40)) in r["image_bytes"] for r in whole) and all(bytes((40, 40, 40)) not in r["image_bytes"] for r in masked)


def test_repair_stays_in_generated_code(spark):
    """The repaired text is computed once and used many times: the plan holds each replacement once a rule."""
    from slatecast.functions import text as rules

    rows = spark.createDataFrame([("VEX;a", "VFX"), ("D1:b", "DI"), ("", "DI"), (None, "VFX"), ("c", None)], "text string, text_type string")
    made = rows.select(rules.normalized(F.col("text"), F.col("text_type")).alias("text")).where("trim(text) <> ''")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") <= 4 * (len(rules.VFX.replacements) + len(rules.DI.replacements)) + 8
    assert [r["text"] for r in made.collect()] == ["VFX:a", "DI:b", "DI:c"]

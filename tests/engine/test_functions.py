import pytest
from pyspark.sql import functions as F

from slatecast.functions import geometry, text
from slatecast.functions.timecode import frame_to_smpte, percent, time_range, time_to_frame


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


LABELS = [
    ("VFX", "VEX:Comp A", "VFX:Comp A"), ("VFX", "VFX;Matte", "VFX:Matte"), ("VFX", "FX:Render", "VFX:Render"), ("VFX", "VFX.X", "VFX:X"),
    ("VFX", "VVFX:Light", "VFX:VVFX:Light"), ("VFX", "VFX磨皮", "VFX:磨皮"), ("VFX", "VFX", "VFX:"), ("VFX", "VEX擦", "VFX:VEX擦"),
    ("VFX", "VEX 擦", "VFX:擦"), ("VFX", "VPX 擦:灯", "VFX:灯"), ("VFX", "VPX:擦", "VFX:VPX:擦"), ("VFX", "vfx:擦", "VFX:vfx:擦"),
    ("VFX", "FX字牌改星光乐团", "VFX:FX字牌改星光乐团"), ("VFX", "", ""),
    ("DI", "D1:Grade", "DI:Grade"), ("DI", "Dl:Cube", "DI:Cube"), ("DI", "01:LUT", "DI:LUT"), ("DI", "DI;x", "DI:x"),
    ("DI", "Di:Grade", "DI::Grade"), ("DI", "Di;Grade", "DI:;Grade"), ("DI", "DiGrade", "DI:Grade"), ("DI", "DI磨皮", "DI:皮"),
    ("DI", "DI.去抖", "DI:去抖"), ("DI", "DI", "DI:"), ("DI", "D1.去抖动", "DI:D1.去抖动"), ("DI", "D1 去", "DI:去"), ("DI", "OI 调:x", "DI:x"),
    ("DI", "DI:场01:30", "DI:场DI:30"), ("DI", "DI:Director", "DI:DI:rector"), ("other", "D1:Grade", "DI:Grade"),
]


def test_labels(spark):
    rows = spark.createDataFrame(LABELS, "kind string, raw string, want string").withColumn("got", text.normalized(F.col("raw"), F.col("kind")))
    assert [(r["raw"], r["got"]) for r in rows.collect()] == [(r[1], r[2]) for r in LABELS]
    assert one(spark, text.normalized(F.lit("DI磨皮"), F.lit("DI"), legacy=True)) == "DI:DI磨皮"


def test_time_codes(spark):
    for frame, code in ((100, "00:00:04:00"), (200, "00:00:08:00"), (6106, "00:04:04:06"), (7722, "00:05:08:22"), (25 * 3600 * 101, "101:00:00:00")):
        assert one(spark, frame_to_smpte(F.lit(frame))) == code
        assert one(spark, time_to_frame(F.lit(code))) == frame
    assert one(spark, frame_to_smpte(F.lit(539), 29.97)).endswith(":30") and one(spark, frame_to_smpte(F.lit(527), 23.976)).endswith(":24")
    for code, frame in (("", 0), ("10", 250), ("1:02", 1550), ("x", None), ("1:2:3:4:5", None), ("0:0:1:99", 124)):
        assert one(spark, time_to_frame(F.lit(code))) == frame
    with pytest.raises(Exception, match="not a time code"):
        one(spark, time_to_frame(F.lit("x:y"), strict=True))
    assert time_range(0, 10**9, 500) == (0, 500) and time_range(600, 700, 500) == (0, 500)
    with pytest.raises(ValueError):
        time_range(20, 20, 500)
    assert one(spark, percent(F.lit(1), F.lit(3))) == "33.33"


def test_likeness_and_strip(spark):
    for a, b, want in (("VFX:Comp A", "VFX:Comp B", 9 / 11), ("", "", 0.0), ("", "a", 0.0), ("aAa", "A", 1.0), ("\U0001f600é", "É", 0.5)):
        assert one(spark, text.similarity(F.lit(a), F.lit(b))) == pytest.approx(want)
    assert one(spark, text.strip(F.lit("　\x1c \t a b \n "))) == "a b"
    assert one(spark, text.base_name(F.lit("/a/b.c/film.v2.mov"))) == "film.v2"


def box(*v):
    return F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)])


def test_boxes(spark):
    assert one(spark, geometry.iou(box(10, 10, 50, 50), box(30, 30, 70, 70))) == pytest.approx(400 / 2800)
    assert one(spark, geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, geometry.iou(box(0, 0, 5, 5), box(5, 0, 9, 5))) == 0
    poly = F.array(*[F.lit(v) for v in (1.9, 2.0, 9.5, 2.0, 9.5, 4.0, -1.9, 4.0)])
    assert tuple(one(spark, geometry.box_of(poly))) == (-1, 2, 9, 4)
    assert tuple(one(spark, geometry.box_of(F.slice(poly, 1, 6)))) == (0, 0, 0, 0)
    assert tuple(one(spark, geometry.largest_box(F.array(box(0, 0, 0, 0), box(0, 0, 2, 2), box(1, 1, 3, 3))))) == (0, 0, 2, 2)
    assert tuple(one(spark, geometry.largest_box(F.array(box(4, 4, 4, 4), box(0, 0, 0, 0))))) == (4, 4, 4, 4)

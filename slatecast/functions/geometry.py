"""Boxes and polygons, as column expressions. A box is a struct x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; 0 without an overlap."""
    left, top = F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"])
    right, bottom = F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"])
    shared = (right - left).cast("double") * (bottom - top)
    joint = area(a) + area(b) - shared
    return F.when((right <= left) | (bottom <= top) | (joint <= 0), F.lit(0.0)).otherwise(shared / joint)


def area(box: Column) -> Column:
    return (box["x2"] - box["x1"]).cast("double") * (box["y2"] - box["y1"])


def box_of(polygon: Column) -> Column:
    """The box around a polygon of x, y, x, y and so on, cut to whole numbers; anything but four points gives zeros."""
    xs = F.filter(polygon, lambda _, k: k % 2 == 0)
    ys = F.filter(polygon, lambda _, k: k % 2 == 1)
    found = F.struct(
        F.array_min(xs).cast("int").alias("x1"),
        F.array_min(ys).cast("int").alias("y1"),
        F.array_max(xs).cast("int").alias("x2"),
        F.array_max(ys).cast("int").alias("y2"),
    )
    zeros = F.struct(*[F.lit(0).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return F.when(F.size(polygon) == 8, found).otherwise(zeros)


def largest_box(boxes: Column) -> Column:
    """The box of the largest area, the first of equals; the first box if none has an area; null if there is none."""
    best = F.aggregate(
        boxes,
        F.struct(F.lit(0.0).alias("area"), F.lit(None).cast(BOX).alias("box")),
        lambda held, box: F.when(area(box) > held["area"], F.struct(area(box).alias("area"), box.alias("box"))).otherwise(held),
    )["box"]
    return F.coalesce(best, F.try_element_at(boxes, F.lit(1)))

"""Detections, pixel grids and markers derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatecast.functions import geometry
from slatecast.sources import files

_VFX, _DI = ("VFX:", "VEX:", "VFX;", "FX:", "VFX", "VFX."), ("DI:", "D1:", "Dl;", "DI.", "Di:", "01:")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    events = _read(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    i, k = F.col("rid"), F.col("k")
    glitch = i % 12 == 0
    rows = events.crossJoin(F.broadcast(parts.agg(F.count(F.lit(1)).alias("np"))))
    rows = rows.withColumn("p_partkey", F.floor(i / 24) % F.col("np")).join(parts, "p_partkey")
    kind = F.when((F.floor(i / 48) % 3 == 0) != (k == 50), "DI").otherwise("VFX")
    prefix = F.when(kind == "VFX", F.get(F.array(*map(F.lit, _VFX)), k % 6)).otherwise(F.get(F.array(*map(F.lit, _DI)), k % 6))
    name = F.when(glitch, F.concat(F.lit("zq"), "event_type")).when(k % 10 == 0, "qzjw").otherwise(F.col("p_name"))
    drift = 2 * (i % 24)
    return rows.select(
        F.concat(F.lit("v"), (F.floor(i / 480) % 7).cast("string")).alias("video_id"),
        "rid",
        (2 * i + k % 2 + 40 * F.floor(i / 40)).alias("frame_number"),
        kind.alias("text_type"),
        (600 + 10 * k).alias("pixel_count"),
        F.least(F.lit(0.08) + F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        F.concat(prefix, name).alias("text"),
        F.when(glitch, 500).otherwise(40 * (F.floor(i / 24) % 3) + drift).cast("int").alias("x1"),
        F.when(glitch, 200).otherwise(5).cast("int").alias("y1"),
        F.when(glitch, 560).otherwise(200 + k % 3 + drift).cast("int").alias("x2"),
        F.when(glitch, 220).otherwise(25 + k % 2).cast("int").alias("y2"),
        "k",
    )


def _choice(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


DET = f"""
det AS (
  SELECT 'v' || ((i // 480) % 7) AS video_id, i AS rid, 2 * i + k % 2 + 40 * (i // 40) AS frame_number, text_type, 600 + 10 * k AS pixel_count, confidence,
    (CASE WHEN text_type = 'VFX' THEN {_choice(_VFX)} ELSE {_choice(_DI)} END)[k % 6 + 1]
      || CASE WHEN i % 12 = 0 THEN 'zq' || event_type WHEN k % 10 = 0 THEN 'qzjw' ELSE p_name END AS text,
    (CASE WHEN i % 12 = 0 THEN 500 ELSE 40 * ((i // 24) % 3) + 2 * (i % 24) END)::INTEGER AS x1, CASE WHEN i % 12 = 0 THEN 200 ELSE 5 END AS y1,
    (CASE WHEN i % 12 = 0 THEN 560 ELSE 200 + k % 3 + 2 * (i % 24) END)::INTEGER AS x2, CASE WHEN i % 12 = 0 THEN 220 ELSE 25 + k % 2 END AS y2, k
  FROM (
    SELECT event_id AS i, k, event_type, least(0.08::DOUBLE + value / 100, 1.0::DOUBLE) AS confidence,
      CASE WHEN ((event_id // 48) % 3 = 0) <> (k = 50) THEN 'DI' ELSE 'VFX' END AS text_type
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)) e
  JOIN part ON p_partkey = (i // 24) % (SELECT count(*) FROM part))"""


def box(*names: str) -> geometry.Column:
    return F.struct(*[F.col(c).cast("int").alias(x) for c, x in zip(names or ("x1", "y1", "x2", "y2"), ("x1", "y1", "x2", "y2"), strict=True)])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pixel of the 8 by 8 grids, with the channels b, g and r."""
    rows = _read(spark, sf_dir, "embeddings").select(F.lit("v0").alias("video_id"), F.col("vec_id").alias("frame_number"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j"))

    def channel(shift: int) -> geometry.Column:
        e = F.get("embedding", (F.col("j") + shift) % 64).cast("double")
        return F.greatest(F.least(F.floor(128 + 600 * e), F.lit(255)), F.lit(0)).cast("int")

    return rows.select("video_id", "frame_number", F.floor(F.col("j") / 8).cast("int").alias("y"), (F.col("j") % 8).alias("x"), channel(0).alias("b"), channel(21).alias("g"), channel(42).alias("r"))


#: Pixels along a side of the square that each cell of an embedding's 8 by 8 grid becomes in a frame.
CELL = 4


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(frame_number, data)``: each embedding's grid as a frame of 32 by 32 pixels, in blue, green and red bytes."""

    def channel(j: geometry.Column, shift: int) -> geometry.Column:
        value = F.greatest(F.least(F.floor(128 + 600 * F.get("embedding", (j + shift) % 64).cast("double")), F.lit(255)), F.lit(0))
        return F.lpad(F.hex(value.cast("long")), 2, "0")

    cells = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.repeat(F.concat(*[channel(j, shift) for shift in (0, 21, 42)]), F.lit(CELL)))
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.repeat(F.array_join(F.slice("cells", y * 8 + 1, F.lit(8)), ""), F.lit(CELL)))
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_number"), cells.alias("cells"))
    return rows.select("frame_number", F.unhex(F.array_join(lines, "")).alias("data"))


def raw_video(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, object]]:
    """A file of those frames, in order, written by many tasks, and the options to read it."""
    path = files.shared_path(spark, "grids.raw")
    files.write_raw_video(frames(spark, sf_dir).orderBy("frame_number"), path)
    return path, {"width": 8 * CELL, "height": 8 * CELL, "video_id": "grids", "frames_per_partition": 100}


PX = """
px AS (
  SELECT 'v0' AS video_id, vec_id AS frame_number, (j // 8)::INTEGER AS y, (j % 8)::INTEGER AS x,
    greatest(least(floor(128 + 600 * embedding[j + 1]::DOUBLE), 255), 0)::INTEGER AS b,
    greatest(least(floor(128 + 600 * embedding[(j + 21) % 64 + 1]::DOUBLE), 255), 0)::INTEGER AS g,
    greatest(least(floor(128 + 600 * embedding[(j + 42) % 64 + 1]::DOUBLE), 255), 0)::INTEGER AS r
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS j FROM embeddings))"""


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections(spark, sf_dir)
    noted = F.col("k") % 10 == 9
    return rows.select(
        F.lit("t0").alias("timeline_id"),
        F.col("frame_number").cast("double").alias("frame_id"),
        F.when(noted, "Blue").when(F.col("text_type") == "VFX", "Green").otherwise("Yellow").alias("color"),
        F.when(noted, "NOTE").otherwise(F.col("text_type")).alias("name"),
        F.col("text").alias("note"),
        F.lit(1.0).alias("duration"),
        F.concat(F.lit("c"), F.col("k").cast("string")).alias("custom_data"),
    )


MK = """
mk AS (
  SELECT 't0' AS timeline_id, frame_number::DOUBLE AS frame_id, CASE WHEN k % 10 = 9 THEN 'Blue' WHEN text_type = 'VFX' THEN 'Green' ELSE 'Yellow' END AS color,
    CASE WHEN k % 10 = 9 THEN 'NOTE' ELSE text_type END AS name, text AS note, 1.0::DOUBLE AS duration, 'c' || k AS custom_data
  FROM det)"""

"""Files of colour tables, markers and detections."""

from __future__ import annotations

import atexit
import codecs
import json
import re
import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatecast.functions.number import three_decimals
from slatecast.functions.text import bound
from slatecast.operators import markers as m
from slatecast.sources.ordered import write_ordered
from slatecast.sources.records import Csv, JsonArray, read_records, same_blocks

#: The header of the detections file.
HEADER = ("帧数", "时间码", "文本内容", "像素数量", "置信度", "类型")


def parse_cube(text: str) -> np.ndarray | list[np.ndarray]:
    """A colour table (the .cube format): an array indexed [r][g][b], or, of one dimension, [value] with a column a channel.

    A file of both sizes holds a shaper of one dimension and the table behind it, and gives a list of the two. Tables
    for values other than 0 to 1 are an error.
    """
    sizes, rows = {1: 0, 3: 0}, []
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        word, *rest = line.split() or [""]
        if found := re.fullmatch("LUT_([13])D_SIZE", word.upper()):
            sizes[int(found[1])] = int(rest[0])
        elif re.fullmatch("DOMAIN_M(IN|AX)|LUT_[13]D_INPUT_RANGE", word.upper()):
            usual = {"DOMAIN_MIN": [0, 0, 0], "DOMAIN_MAX": [1, 1, 1]}.get(word.upper(), [0, 1])
            if [float(x) for x in rest] != usual:
                raise ValueError("a colour table for values other than 0 to 1")
        elif re.match(r"^[-+.\d]", line):
            rows.append([float(x) for x in line.split()[:3]])
    one, three = sizes[1], sizes[3]
    if 1 in (one, three) or not one + three or len(rows) != one + three**3 or any(len(x) != 3 for x in rows):
        raise ValueError("not a colour table")
    values = np.array(rows)
    tables = [values[:one]] if one else []
    if three:
        tables.append(values[one:].reshape(three, three, three, 3).transpose(2, 1, 0, 3))  # red runs fastest in the file
    return tables if len(tables) > 1 else tables[0]


def read_cube(spark: SparkSession, path: str) -> np.ndarray | list[np.ndarray]:
    return parse_cube("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one file, one row


def read_marker_csv(spark: SparkSession, path: str, frame: int = 0, note: int = 2, kind: int = 5, header: bool = True, timeline: str = "t0") -> DataFrame:
    """Markers of a CSV file by the numbers of its columns, with ``ok``; rows of too few fields are not counted at all.

    Quoted fields may hold quotes and line ends. A missing file gives no rows. Files are read in blocks by many tasks;
    if a quoted field of one goes on behind its quotes, has no end, or its lines end by single CRs, each is read whole by one.
    """
    columns = [f"c{k}" for k in range(max(frame, note, kind) + 1)]
    schema = ", ".join(f"{c} string" for c in [*columns, "_bad"])
    # empty fields and missing ones both read as null; rows of another number of fields are kept as they stand, too, so
    # that their separators outside quotes can be counted
    options = {"header": header, "multiLine": True, "escape": '"', "columnNameOfCorruptRecord": "_bad", "enforceSchema": True}
    try:
        with same_blocks(spark):
            records = read_records(spark, path, Csv(header))
            if records is None:
                rows = spark.read.schema(schema).options(**options).csv(path)
            else:
                one = {k: v for k, v in options.items() if k not in ("header", "multiLine", "enforceSchema")}
                rows = written(records.select(F.from_csv("value", schema, one).alias("r")).select("r.*"))
        bare = F.regexp_replace("_bad", '"([^"]|"")*"', "")
        rows = rows.where(F.col("_bad").isNull() | (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) >= len(columns) - 1))
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], schema)
    return m.from_rows(rows.select(F.col(columns[frame]).alias("frame"), F.col(columns[note]).alias("note"), F.col(columns[kind]).alias("kind")), timeline=timeline)


def read_marker_json(spark: SparkSession, path: str, timeline: str = "t0") -> DataFrame:
    """The markers of a JSON file, or of several, each an object with an array ``markers``.

    Files are read in blocks by many tasks; if one is no single object that is closed, each is read whole by one.
    """
    kind = "struct<frame_id:double,color:string,name:string,note:string,duration:double,custom_data:string>"
    with same_blocks(spark):
        records = read_records(spark, path, JsonArray("markers"))
        if records is None:
            rows = spark.read.schema(f"markers array<{kind}>").option("multiLine", True).json(path).select(F.explode("markers").alias("m"))
        else:
            rows = written(records.select(F.from_json("value", kind).alias("m")))
    return rows.select(F.lit(timeline).alias("timeline_id"), "m.*")


def _json_value(column: str) -> Column:
    """One value as JSON has it."""
    whole = F.to_json(F.struct(F.col(column).alias("v")), {"ignoreNullFields": "false"})
    return bound(whole, lambda w: F.substr(w, F.lit(6), F.length(w) - 6))


def write_marker_json(markers: DataFrame, path: str) -> str:
    """What ``markers.summary`` tells, as an indented JSON file; a missing range stays null.

    The counts are summed up first; the markers, in order, are written by many tasks.
    """
    counts = {r["color"]: r["n"] for r in m.colour_counts(markers).orderBy("color").collect()}  # a row a colour
    low, high = markers.agg(F.min("frame_id"), F.max("frame_id")).first()
    head = {"total_count": sum(counts.values()), "colors": counts, "frame_range": {"min": low, "max": high} if counts else None}
    start = json.dumps(head, indent=2, ensure_ascii=False).removesuffix("\n}") + ',\n  "markers": ['
    parts: list[Column] = [F.lit("    {")]
    for k, name in enumerate(m.FIELDS):
        parts += [F.lit(f'{"," if k else ""}\n      "{name}": '), _json_value(name)]
    rows = markers.select(*m.FIELDS).orderBy(*m.FIELDS).select(F.concat(*parts, F.lit("\n    }")).alias("value"))
    lead, end = ("\n", "\n  ]\n}") if counts else ("", "]\n}")
    return write_ordered(rows, path, (start + lead).encode(), end.encode(), b",\n")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path on the file system that the driver and the executors share (``spark.checkpoint.dir``); a local one for a local master only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if folder:
        made = Path(folder.removeprefix("file://").removeprefix("file:"), f"files-{uuid.uuid4().hex}")
    else:
        made = Path(tempfile.mkdtemp(prefix="files-"))
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    made.mkdir(parents=True, exist_ok=True)
    return str(made / name)


def detections_name(video: str, legacy: bool = False) -> str:
    """The usual name of the detections file of a video."""
    name = re.sub(r"(?<=.)\.[^.]*$", "", re.split(r"[/\\]", video)[-1])
    return f"{name}_detected_frames_paddle{'' if legacy else '_refactored'}.csv"


def _csv_line(columns: list[Column]) -> Column:
    """A line of a CSV file: quotes where a field has a comma, a quote or a line end; null is empty."""

    def field(value: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(value.rlike('[,"\r\n]'), quoted).otherwise(F.coalesce(value, F.lit("")))

    return F.concat(F.concat_ws(",", *[bound(c.cast("string"), field) for c in columns]), F.lit("\r\n"))


def write_detections_csv(rows: DataFrame, path: str) -> str:
    """One CSV file in the order of ``rows``: byte-order mark, CRLF line ends, quotes where needed. Many tasks write it."""
    columns = [F.col(c) for c in ("frame_number", "timecode", "text", "pixel_count")]
    lines = rows.select(_csv_line([*columns, three_decimals(F.col("confidence")), F.col("text_type")]).alias("value"))
    return write_ordered(lines, path, codecs.BOM_UTF8 + (",".join(HEADER) + "\r\n").encode())


def read_detections_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a detections file, with ``line``: where each stands, from 1. A file is read in parts where no text holds a line end.

    Lines are numbered by counting them part by part and adding up the parts before.
    """
    schema = "frame_number long, timecode string, text string, pixel_count long, confidence double, text_type string"
    rows = spark.read.schema(schema).options(header=True, escape='"', enforceSchema=True).csv(path)
    return numbered(rows.withColumn("at", F.monotonically_increasing_id()))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows(at, …)`` with ``line`` in place of ``at``, a number as ``monotonically_increasing_id`` gives it."""
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a task
    starts = F.broadcast(sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")))
    return rows.withColumn("part", part).join(starts, "part").withColumn("line", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + 1).drop("at", "part", "before")


def write_raw_video(frames: DataFrame, path: str) -> str:
    """Frames, ``data`` in the order of ``frames``, one after another, as ``RawDecoder`` reads them."""
    return write_ordered(frames.select(F.col("data").alias("value")), path)


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written where all executors find them, so that what made them is done once and lost executors cost nothing."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir") or shared_path(spark, "checkpoints"))
    return rows.checkpoint()

"""Video frames as a Python data source: ``spark.read.format("frames")``, and ``spark.readStream`` of a growing file.

Files that end like a container (MP4, MOV, AVI) are read through OpenCV where it is installed, all others as raw BGR
frames (24 bits a pixel, one after another); another decoder is given by the option ``decoder``, the import path of a
class like ``RawDecoder``. A range of frames becomes input partitions that are read apart; a frame that cannot be read
ends its range. Comparisons of ``frame_number`` with numbers narrow that range before anything is opened.

Frames that a table names are read by ``frames_at``, block by block in seek order.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import takewhile
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from slatecast.functions.dealing import dealt
from slatecast.functions.timecode import time_range
from slatecast.params import DEFAULT, Params

SCHEMA = "video_id string, frame_number long, height int, width int, channels int, data binary"
INFO = "video_id string, fps double, frame_count long, width int, height int, duration_seconds double"


class Decoder(Protocol):
    fps: float
    frame_count: int
    width: int
    height: int

    def read(self, frame: int) -> bytes | None: ...


class RawDecoder:
    """Frames of equal size lying one after another; a file that cannot be opened is an error."""

    def __init__(self, path: str, options: dict[str, str]) -> None:
        self.path = path
        self.width, self.height = int(options["width"]), int(options["height"])
        self.fps = float(options.get("fps", 0)) or DEFAULT.fps
        self.size = 3 * self.width * self.height
        self.file = open(path, "rb")  # noqa: SIM115  closed with the decoder
        self.frame_count = self.file.seek(0, 2) // self.size

    def read(self, frame: int) -> bytes | None:
        self.file.seek(frame * self.size)
        data = self.file.read(self.size)
        return data if len(data) == self.size else None


class ContainerDecoder:
    """Any container and codec that OpenCV can open; it is asked to seek only where a frame is not the next one."""

    def __init__(self, path: str, options: dict[str, str]) -> None:
        try:
            import cv2
        except ImportError as missing:
            raise RuntimeError("video containers need the package cv2, or the option decoder") from missing
        self.video, self.position, self.next = cv2.VideoCapture(path), cv2.CAP_PROP_POS_FRAMES, 0
        if not self.video.isOpened():
            raise OSError(f"cannot open {path}")
        self.fps = float(self.video.get(cv2.CAP_PROP_FPS)) or DEFAULT.fps
        self.frame_count, self.width, self.height = (int(self.video.get(x)) for x in (cv2.CAP_PROP_FRAME_COUNT, cv2.CAP_PROP_FRAME_WIDTH, cv2.CAP_PROP_FRAME_HEIGHT))

    def read(self, frame: int) -> bytes | None:
        if frame != self.next:
            self.video.set(self.position, frame)
        found, image = self.video.read()
        self.next = frame + 1
        return image.tobytes() if found else None


CONTAINERS = (".mp4", ".mov", ".avi")


def open_decoder(options: dict[str, str]) -> Decoder:
    usual = "ContainerDecoder" if options["path"].lower().endswith(CONTAINERS) else "RawDecoder"
    module, _, name = options.get("decoder", f"{__name__}.{usual}").rpartition(".")
    return getattr(importlib.import_module(module), name)(options["path"], options)


@dataclass
class Frames(InputPartition):
    start: int
    end: int


#: Pixels that go on at once, but for a frame that is larger.
BATCH_BYTES = 1 << 20

_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_KINDS = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _video_id(options: dict[str, str]) -> str:
    return options.get("video_id", options["path"])


def _ranges(start: int, end: int, options: dict[str, str]) -> list[Frames]:
    step = int(options.get("frames_per_partition", 1000))
    return [Frames(k, min(k + step, end)) for k in range(start, end, step)]


def _decoded(options: dict[str, str], numbers: range) -> Iterator[pa.RecordBatch]:
    """The frames of a range up to the first that cannot be read, a few small ones or one large one a batch."""
    if not numbers:
        return
    decoder = open_decoder(options)
    step = _rows_of_a_batch(decoder)
    for at in range(0, len(numbers), step):
        some = numbers[at : at + step]
        found = list(takewhile(lambda data: data is not None, map(decoder.read, some)))
        if found:
            values = (_video_id(options), decoder.height, decoder.width, 3)
            video, height, width, channels = (pa.array([v] * len(found)) for v in values)
            columns = (video, pa.array(some[: len(found)]), height, width, channels, pa.array(found))
            yield pa.record_batch([c.cast(k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)
        if len(found) < len(some):
            return


def _rows_of_a_batch(decoder: Decoder) -> int:
    return max(1, BATCH_BYTES // max(1, 3 * decoder.width * decoder.height))


class FrameReader(DataSourceReader):
    """[start_frame, end_frame), or both ends included with ``inclusive``, narrowed by what a query asks of ``frame_number``."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.low, self.high = None, None  # both included
        self.nothing = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if not self._takes(one):
                yield one

    def _takes(self, one: Filter) -> bool:
        """Whether the filter is met by which frames are read."""
        column, value = getattr(one, "attribute", None), getattr(one, "value", None)
        if isinstance(one, IsNotNull):
            return column in (("frame_number",), ("video_id",))
        if column == ("video_id",) and isinstance(one, EqualTo):
            self.nothing |= value != _video_id(self.options)
            return True
        if column != ("frame_number",) or not isinstance(value, int | tuple | list):
            return False
        if isinstance(one, In):
            numbers = [x for x in value if x is not None]
            self.nothing |= not numbers
            if numbers:
                self._within(min(numbers), max(numbers))
            return False  # frames between are left out by Spark
        low = {EqualTo: value, GreaterThanOrEqual: value, GreaterThan: value + 1}.get(type(one))
        high = {EqualTo: value, LessThanOrEqual: value, LessThan: value - 1}.get(type(one))
        self._within(low, high)
        return low is not None or high is not None

    def _within(self, low: int | None, high: int | None) -> None:
        self.low = max((x for x in (self.low, low) if x is not None), default=None)
        self.high = min((x for x in (self.high, high) if x is not None), default=None)

    def partitions(self) -> list[Frames]:
        count = open_decoder(self.options).frame_count
        last = int(self.options.get("end_frame", count)) + (str(self.options.get("inclusive", "")).lower() == "true")
        start, end = time_range(int(self.options.get("start_frame", 0)), last, count)
        start = start if self.low is None else max(start, self.low)
        end = end if self.high is None else min(end, self.high + 1)
        # without a partition there would be no task, which Spark takes amiss
        return ([] if self.nothing else _ranges(start, end, self.options)) or [Frames(0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        return _decoded(self.options, range(partition.start, partition.end))


class FrameStream(DataSourceStreamReader):
    """A file that grows: each batch has the whole frames that came since the last. An offset is the next frame's number."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"frame": int(self.options.get("start_frame", 0))}

    def latestOffset(self) -> dict:
        start = self.initialOffset()["frame"]
        return {"frame": max(start, min(open_decoder(self.options).frame_count, int(self.options.get("end_frame", 1 << 62))))}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        return _ranges(start["frame"], end["frame"], self.options)

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        """A range that was announced is there; one that cannot be read whole is an error, or frames would be lost."""
        n = 0
        for batch in _decoded(self.options, range(partition.start, partition.end)):
            n += batch.num_rows
            yield batch
        if n < partition.end - partition.start:
            raise OSError(f"frame {partition.start + n} of {self.options['path']} cannot be read")


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FrameReader:
        return FrameReader(dict(self.options))

    def streamReader(self, schema: object) -> FrameStream:
        return FrameStream(dict(self.options))


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a session's setting; sources without filters do not mind


def read_frames(spark: SparkSession, path: str, **options: object) -> DataFrame:
    _registered(spark)
    return spark.read.format("frames").options(path=path, **options).load()


def stream_frames(spark: SparkSession, path: str, **options: object) -> DataFrame:
    _registered(spark)
    return spark.readStream.format("frames").options(path=path, **options).load()


#: Rows of a block of frames that one task takes.
MOST_ROWS = 1 << 16


def frames_at(wanted: DataFrame, path: str, block: int = 1000, most: int | None = MOST_ROWS, **options: object) -> DataFrame:
    """``wanted(frame_number, …)`` with the frames of those numbers: ``video_id, height, width, channels, data``.

    Rows are dealt by blocks of frames and read in seek order, with one decoder a task; a frame that several rows want is
    decoded once a task. A block that more than ``most`` rows want goes to several tasks (None: it goes to one, and rows are not
    counted first). Numbers that are null, or that no frame has, are passed over. Further columns of ``wanted`` stay, except
    that those five are the video's.
    """
    named = {"path": path} | {k: str(v) for k, v in options.items()}
    made = [c for c in _NAMES if c != "frame_number"]
    kept = [c for c in wanted.columns if c not in made]
    rows = wanted.select(*kept).where("frame_number is not null")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(c for c in SCHEMA.split(", ") if c.split()[0] in made)])

    place = [F.floor(F.col("frame_number") / block)]
    if most is not None:
        crowded = rows.groupBy(place[0].alias("_block")).agg(F.ceil(F.count(F.lit(1)) / most).alias("_ways")).where("_ways > 1")
        rows = rows.join(F.broadcast(crowded), place[0] == F.col("_block"), "left")
        place.append(F.pmod(F.xxhash64(*kept), F.coalesce("_ways", F.lit(1))))
    by_block = dealt(rows, *place).select(*kept).sortWithinPartitions("frame_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, at, data = None, None, None
        for whole in batches:
            decoder = decoder or open_decoder(named)
            step = _rows_of_a_batch(decoder)
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                rows, of, images = [], [], []
                for k, frame in enumerate(batch["frame_number"].to_pylist()):
                    if frame != at:
                        at, data = frame, decoder.read(frame) if 0 <= frame < decoder.frame_count else None
                    if data is not None:
                        if not images or images[-1] is not data:
                            images.append(data)
                        rows.append(k)
                        of.append(len(images) - 1)
                if rows:
                    values = {"video_id": _video_id(named), "height": decoder.height, "width": decoder.width, "channels": 3}
                    columns = {c: pa.array([v] * len(rows), _KINDS[_NAMES.index(c)]) for c, v in values.items()}
                    columns["data"] = pa.array(images, pa.binary()).take(pa.array(of))
                    yield pa.record_batch([*batch.take(pa.array(rows)).select(kept).columns, *(columns[c] for c in made)], [*kept, *made])

    return by_block.mapInArrow(run, schema)


def video_info(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """One row: frame rate, count, size and length of a video; a missing frame rate counts as 25."""
    decoder = open_decoder({"path": path} | {k: str(v) for k, v in options.items()})
    return spark.createDataFrame([(options.get("video_id", path), decoder.fps, decoder.frame_count, decoder.width, decoder.height, decoder.frame_count / decoder.fps)], INFO)


def frame_numbers(spark: SparkSession, start: int, end: int) -> DataFrame:
    return spark.range(start, end).withColumnRenamed("id", "frame_number")


_SHAPE = "struct<h:int,w:int,c:int>"


def counts_of(frames: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row for each frame and colour with enough pixels: type and pixel count. Pixels stay where they are decoded."""
    from slatecast.operators.pixels import frame_hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = [(k, kind, n) for k, bgr in _images(whole) for kind, n, _ in frame_hits(bgr, params)]
            if rows:
                at, kinds, counts = zip(*rows, strict=True)
                same = whole.select(["video_id", "frame_number"]).take(pa.array(at))
                yield pa.record_batch([*same.columns, pa.array(kinds), pa.array(counts, pa.int32())], ["video_id", "frame_number", "text_type", "pixel_count"])

    return _numbered(frames.select("video_id", "frame_number", "height", "width", "data").mapInArrow(run, "video_id string, frame_number long, text_type string, pixel_count int"))


def regions_of(chosen: DataFrame, params: Params = DEFAULT, masked: bool = True) -> DataFrame:
    """``chosen(text_type, …)`` with a frame's columns, the region of that type in place of the frame: ``image_shape, image_bytes``."""
    from slatecast.operators.pixels import frame_hits

    kept = [c for c in chosen.columns if c not in ("height", "width", "channels", "data")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name in kept), f"image_shape {_SHAPE}", "image_bytes binary"])
    shape = pa.struct([(x, pa.int32()) for x in "hwc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            types = whole["text_type"].to_pylist()
            hits = ((k, dict(zip("hwc", roi.shape, strict=True)), roi.tobytes()) for k, bgr in _images(whole) for kind, _, roi in frame_hits(bgr, params, masked) if kind == types[k])
            for some in _by_bytes(hits):
                at, shapes, images = zip(*some, strict=True)
                same = whole.select(kept).take(pa.array(at))
                yield pa.record_batch([*same.columns, pa.array(shapes, shape), pa.array(images)], [*kept, "image_shape", "image_bytes"])

    return chosen.mapInArrow(run, schema)


def _images(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The frame of each row as an array."""
    for k, (height, width) in enumerate(zip(batch["height"].to_pylist(), batch["width"].to_pylist(), strict=True)):
        yield k, np.frombuffer(batch["data"][k].as_buffer(), np.uint8).reshape(height, width, 3)


def _by_bytes(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows, whose last field is an image, in lists of some BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _numbered(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rid", F.col("frame_number") * 2 + (F.col("text_type") == "DI").cast("int"))


def hits_of(frames: DataFrame, params: Params = DEFAULT, masked: bool = True) -> DataFrame:
    """``counts_of`` with the regions, masked or as they are, from one decoding."""
    from slatecast.operators.pixels import frame_hits

    schema = f"video_id string, frame_number long, text_type string, pixel_count int, image_shape {_SHAPE}, image_bytes binary"
    kinds = (pa.string(), pa.int32(), pa.struct([(x, pa.int32()) for x in "hwc"]), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            hits = ((k, kind, n, dict(zip("hwc", roi.shape, strict=True)), roi.tobytes()) for k, bgr in _images(whole) for kind, n, roi in frame_hits(bgr, params, masked))
            for some in _by_bytes(hits):
                at, *values = zip(*some, strict=True)
                columns = [pa.array(v, t) for v, t in zip(values, kinds, strict=True)]
                same = whole.select(["video_id", "frame_number"]).take(pa.array(at))
                yield pa.record_batch([*same.columns, *columns], ["video_id", "frame_number", "text_type", "pixel_count", "image_shape", "image_bytes"])

    return _numbered(frames.select("video_id", "frame_number", "height", "width", "data").mapInArrow(run, schema))

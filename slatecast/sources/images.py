"""Cut-out regions as PNG images: encoded into a column, and written as files to look at."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(bgr: np.ndarray) -> bytes:
    """A PNG file of 8-bit colours; an image of no pixels or another shape is an error."""
    if bgr.ndim != 3 or bgr.shape[2] != 3 or not bgr.size or bgr.dtype != np.uint8:
        raise ValueError("an image is an array of bytes, height by width by 3")
    height, width = bgr.shape[:2]
    lines = np.zeros((height, 1 + 3 * width), np.uint8)  # each line begins with its filter, here none
    lines[:, 1:] = bgr[..., ::-1].reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The pixels (blue, green, red) of a PNG file of ``encode_png``; anything else is an error."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, packed = 8, b"", b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    if len(head) != 13 or head[8:] != bytes((8, 2, 0, 0, 0)):
        raise ValueError("not an image of 8-bit colours in whole lines")
    width, height = struct.unpack(">II", head[:8])
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + 3 * width)
    if lines[:, 0].any():
        raise ValueError("lines are filtered")
    return lines[:, 1:].reshape(height, width, 3)[..., ::-1]


def with_png(rows: DataFrame) -> DataFrame:
    """``image_bytes`` of shape ``image_shape`` as PNG files; rows whose image cannot be encoded go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for data, shape in zip(batch["image_bytes"].to_pylist(), batch["image_shape"].to_pylist(), strict=True):
                try:
                    out.append(encode_png(np.frombuffer(data, np.uint8).reshape(shape["h"], shape["w"], shape["c"])))
                except (TypeError, ValueError):
                    out.append(None)
            done = batch.set_column(batch.schema.get_field_index("image_bytes"), "image_bytes", pa.array(out, pa.binary()))
            yield done.filter(pa.array([x is not None for x in out], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def _folder_of(video: str) -> str:
    """A folder's name for a video: its base name as far as that is safe, and a hash of the whole name, which tells it from others."""
    base = re.sub(r"[^\w.-]", "_", re.split(r"[/\\]", video)[-1])[:80]
    return f"{base}-{zlib.crc32(video.encode()):08x}"


def write_images(rows: DataFrame, folder: str) -> DataFrame:
    """One file ``{video}/roi_{frame}_{type}.png`` for each row of ``with_png``, in a folder all executors share; their paths and sizes.

    Each video has a folder of its own (rows without a video lie in ``folder`` itself). A file gets its name when it is
    whole, and writing it again gives the same file, so lost tasks may be repeated.
    """
    video = F.col("video_id") if "video_id" in rows.columns else F.lit(None).cast("string")
    named = rows.select(video.alias("video"), F.format_string("roi_%d_%s.png", F.col("frame_number"), F.col("text_type")).alias("name"), "image_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = [], []
            for video, name, data in zip(*(batch[c].to_pylist() for c in ("video", "name", "image_bytes")), strict=True):
                own = os.path.join(folder, _folder_of(video)) if video is not None else folder
                os.makedirs(own, exist_ok=True)
                paths.append(os.path.join(own, name))
                half = f"{paths[-1]}.{uuid.uuid4().hex}.half"
                try:
                    with open(half, "wb") as file:
                        sizes.append(file.write(data))
                    os.replace(half, paths[-1])
                finally:
                    if os.path.exists(half):
                        os.remove(half)
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "n_bytes"])

    return named.mapInArrow(run, "path string, n_bytes long")

"""Media columns: payloads kept as lossless WebP images, pixel arrays read back, and features of the pixels.

A payload longer than one image can hold goes on in further images, joined end to end. The decoder is that of any
lossless WebP file; the encoder makes grey-scale ones, whose samples lie in the green channel.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatecast.llm import webp
from slatecast.llm.common import map_batches, utf8

#: Samples in a row, and so the unit to which payloads are filled up.
ROW = 64


def padded(raw: bytes, unit: int = ROW) -> bytes:
    """``raw`` and bytes 0 up to a positive multiple of ``unit``."""
    return raw + b"\0" * (max(-(-len(raw) // unit), 1) * unit - len(raw))


def store(payload: bytes, row: int = ROW) -> bytes:
    """The payload as images of ``row`` samples a row, each as high as the format allows."""
    most = row * webp.MAX_SIDE
    return b"".join(webp.encode_bytes(payload[at : at + most], row) for at in range(0, len(payload), most))


def images(media: bytes) -> list[np.ndarray]:
    """The pixel arrays (height, width, red green blue alpha) of WebP files joined end to end."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(webp.decode(media[at : at + size]))
        at += size
    return out


def load(media: bytes) -> bytes:
    """The samples that ``store`` was given."""
    return b"".join(pixels[..., 1].tobytes() for pixels in images(media))


def feature(pixels: np.ndarray) -> str:
    """Sixty-four bits of a grid of 8 by 8 cells, set where a cell is lighter than the whole, then mean and spread in thousandths."""
    height, width = pixels.shape
    rows, columns = np.arange(8) * height // 8, np.arange(8) * width // 8
    tall = np.maximum(np.diff(np.append(rows, height)), 1)
    wide = np.maximum(np.diff(np.append(columns, width)), 1)
    cells = np.add.reduceat(np.add.reduceat(pixels, rows, axis=0, dtype=np.float64), columns, axis=1) / np.outer(tall, wide)
    mean = float(pixels.mean())
    bits = np.packbits((cells > mean).ravel()).tobytes().hex()
    return f"{bits}-{mean:.3f}-{float(pixels.std()):.3f}"


def texts_as_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media, payload_bytes, payload_sha256, tail_crc32, feature)`` for every row of ``docs``.

    A null text is empty and fills one row of zeros. Repeated rows each come out, with equal values; null ids stay null;
    other columns are ignored; an empty table gives an empty table.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for raw in batch["text"].to_pylist():
                media = store(padded(raw))
                back = load(media)
                rows.append((len(raw), media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), feature(np.frombuffer(back, np.uint8).reshape(-1, ROW))))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string())
            return pa.record_batch([batch["doc_id"], *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()), "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string", make)


def pixel_arrays(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns of ``media`` and ``images``: for each WebP file in the column its height, width and RGBA bytes.

    Null or empty media have no images; a broken file gives null, so that one bad row does not end a job.
    """

    @F.udf("array<struct<height int, width int, pixels binary>>", useArrow=True)
    def read_images(raw: bytes | None) -> list | None:
        try:
            return [(p.shape[0], p.shape[1], p.tobytes()) for p in images(bytes(raw or b""))]
        except (ValueError, IndexError, struct.error):
            return None

    return media.withColumn("images", read_images(F.col(column)))

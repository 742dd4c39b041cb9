"""Text recognition as a pluggable engine, and what is made of its answers."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatecast.functions.geometry import BOX, box_of, largest_box
from slatecast.functions.text import bound, strip

ITEM = "struct<rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<array<double>>>"
#: Name of the text that the engine for tests gives (fixed value).
MOCK_TEXT, MOCK_SCORE = "模拟OCR结果_", 0.85


class Engine(Protocol):
    def __call__(self, frame_number: int, image: bytes | None) -> list[dict] | None:
        """The recognised items of an image: dicts with rec_texts, rec_scores and rec_polys; None if there is none."""


def mock_engine() -> Engine:
    """Says the frame's number, with no polygon."""
    return lambda frame_number, image: [{"rec_texts": [f"{MOCK_TEXT}{frame_number}"], "rec_scores": [MOCK_SCORE], "rec_polys": []}]


def paddle_engine() -> Engine:
    """PaddleOCR, where it is installed, for images as ``sources.images.with_png`` makes them."""
    from paddleocr import PaddleOCR

    from slatecast.sources.images import decode_png

    reader = PaddleOCR(lang="ch", use_textline_orientation=False, use_doc_unwarping=False)
    return lambda frame_number, image: reader.predict(decode_png(image)[..., ::-1].copy())


def installed_engine() -> Engine:
    """PaddleOCR, or the engine for tests where that is not installed."""
    return paddle_engine() if importlib.util.find_spec("paddleocr") else mock_engine()


def recognized(frames: DataFrame, make_engine: Callable[[], Engine] = mock_engine, image: str = "image_bytes") -> DataFrame:
    """``frames`` less the image, with ``items``: what the engine read; one engine a task, made when first needed.

    A frame at which the engine fails has null items and ``failed`` set, so failures can be counted; no frame is lost.
    """
    kept = [c for c in frames.columns if c != image]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name != image), f"items array<{ITEM}>", "failed boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        polygon = pa.list_(pa.float64())
        kind = pa.list_(pa.struct([("rec_texts", pa.list_(pa.string())), ("rec_scores", pa.list_(pa.float64())), ("rec_polys", pa.list_(polygon))]))
        for batch in batches:
            engine = engine or make_engine()
            items, failed = [], []
            for number, data in zip(batch["frame_number"].to_pylist(), batch[image].to_pylist(), strict=True):
                try:
                    items.append([_flat(x) for x in engine(number, data) or []])
                    failed.append(False)
                except Exception:  # noqa: BLE001  an engine may fail in any way; the row says so
                    items.append(None)
                    failed.append(True)
            yield pa.record_batch([*(batch[c] for c in kept), pa.array(items, kind), pa.array(failed)], [*kept, "items", "failed"])

    return frames.mapInArrow(run, schema)


def _flat(item: dict) -> dict:
    """Polygons as lists of numbers, whatever shape the engine gives them."""

    def numbers(x: object) -> list[float]:
        return [y for part in x for y in numbers(part)] if hasattr(x, "__iter__") else [float(x)]

    return {"rec_texts": list(item.get("rec_texts") or []), "rec_scores": [float(s) for s in item.get("rec_scores") or []], "rec_polys": [numbers(p) for p in item.get("rec_polys") or []]}


def _fragments(item: Column) -> Column:
    """Text, score and box of each fragment with any text: as many as there are both texts and scores."""
    n = F.least(F.size(item["rec_texts"]), F.size(item["rec_scores"]))
    zeros = F.lit(None).cast("array<double>")
    each = F.transform(
        F.slice(item["rec_texts"], F.lit(1), n),
        lambda text, k: F.struct(text.alias("text"), F.get(item["rec_scores"], k).alias("score"), box_of(F.coalesce(F.get(item["rec_polys"], k), zeros)).alias("bbox")),
    )
    return F.filter(each, lambda x: x["text"].isNotNull() & (x["text"] != ""))


def assembled(rows: DataFrame, all_items: bool = False) -> DataFrame:
    """Detections from ``items``: ``text``, ``confidence``, ``bbox``, ``fragments``; frames with no fragment go.

    Only the last item counts (or all, the older way). Stripped texts are joined without anything between; confidence is
    the mean over fragments, those of blanks included; the box is the largest.
    """
    item = F.try_element_at(F.col("items"), F.lit(-1))
    found = F.flatten(F.transform("items", _fragments)) if all_items else F.when(item.isNotNull(), bound(item, _fragments))
    # a generator gives the fragments once, as a column that later ones only read; frames without any give no row
    some = F.filter(F.array(F.coalesce(found, F.array().cast(f"array<struct<text:string,score:double,bbox:{BOX}>>"))), lambda each: F.size(each) > 0)
    rows = rows.select(*[c for c in rows.columns if c != "fragments"], F.explode(some).alias("fragments"))
    total = F.aggregate("fragments", F.lit(0.0), lambda held, x: held + x["score"])
    return rows.withColumns({
        "text": F.array_join(F.transform("fragments", lambda x: strip(x["text"])), ""),
        "confidence": total / F.size("fragments"),
        "bbox": largest_box(F.transform("fragments", lambda x: x["bbox"])),
    })

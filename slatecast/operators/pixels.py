"""Coloured caption pixels: as expressions over a table of pixels, and as numpy kernels over whole frames.

Both give the same numbers; tables of pixels suit checks and small regions, the kernels suit decoded frames, of which
only counts and cut-out regions leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatecast.functions.text import bound
from slatecast.params import DEFAULT, Params


def hls(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees, lightness and saturation in 255ths, each rounded half to even."""
    b, g, r = (c.cast("double") / 255 for c in (b, g, r))
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    wide, both = top - low, top + low
    light = both / 2
    flat = wide == 0
    vivid = F.when(flat, 0.0).when(light < 0.5, wide / both).otherwise(wide / (2 - top - low))
    turn = F.when(flat, 0.0).when(top == r, 60 * (g - b) / wide).when(top == g, 120 + 60 * (b - r) / wide).otherwise(240 + 60 * (r - g) / wide)
    turn = F.when(turn < 0, turn + 360).otherwise(turn)
    return tuple(F.rint(x).cast("int") for x in (turn / 2, light * 255, vivid * 255))


def with_hls(pixels: DataFrame) -> DataFrame:
    h, l, s = hls(F.col("b"), F.col("g"), F.col("r"))
    return pixels.withColumns({"h": h, "l": l, "s": s})


def within(low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """Whether h, l and s lie in a range, both ends included."""
    return F.col("h").between(low[0], high[0]) & F.col("l").between(low[1], high[1]) & F.col("s").between(low[2], high[2])


def region(pixels: DataFrame, width: int, height: int, params: Params = DEFAULT) -> DataFrame:
    """The pixels of the caption region: upper rows, right-hand columns."""
    return pixels.where((F.col("y") < int(height * params.roi_height)) & (F.col("x") >= int(width * params.roi_left)))


def opened(masks: DataFrame, flag: str = "mask") -> DataFrame:
    """``flag`` after a morphological opening by 3 by 3; neighbours beyond the edge do not count."""
    rows = Window.partitionBy("video_id", "frame_number", "y").orderBy("x").rowsBetween(-1, 1)
    columns = Window.partitionBy("video_id", "frame_number", "x").orderBy("y").rowsBetween(-1, 1)
    out = masks
    for fold in (F.min, F.max):
        for window in (rows, columns):
            out = out.withColumn(flag, fold(flag).over(window))
    return out


#: Pixels of a word of a packed mask.
WORD = 32


def packed(pixels: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Per frame ``across``, words in a row, and the masks ``valid`` and of each flag: rows one after another, a bit a pixel.

    One exchange brings a frame's flags together; what follows needs no other. A frame's pixels fill a rectangle.
    """
    key = ["video_id", "frame_number"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("x") % WORD).cast("int"))
    marked = pixels.select(*key, "y", "x", *[flag.alias(name) for name, flag in flags.items()]).repartition(*key)
    words = marked.groupBy(*key, "y", F.floor(F.col("x") / WORD).alias("word")).agg(F.bit_or(bit).alias("valid"), *[F.bit_or(F.when(F.col(name), bit).otherwise(F.lit(0).cast("long"))).alias(name) for name in flags])
    rows = words.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("y", "word", "valid", *flags))).alias("words"))
    across = (F.array_max(F.col("words")["word"]) - F.array_min(F.col("words")["word"]) + 1).cast("int")
    return rows.select(*key, across.alias("across"), *[F.col("words")[name].alias(name) for name in ("valid", *flags)])


def _dilated(mask: Column, across: Column) -> Column:
    """Each bit spread to its eight neighbours: by shifts along rows, then by the rows above and below."""
    shift = F.call_function
    one = F.lit(1)

    def wide(m: Column) -> Column:
        def word(w: Column, k: Column) -> Column:
            before = F.when(k % across != 0, shift("shiftright", F.get(m, k - 1), F.lit(WORD - 1))).otherwise(F.lit(0))
            after = F.when((k + 1) % across != 0, shift("shiftleft", F.get(m, k + 1).bitwiseAND(one), F.lit(WORD - 1))).otherwise(F.lit(0))
            return w.bitwiseOR(shift("shiftleft", w, one)).bitwiseOR(shift("shiftright", w, one)).bitwiseOR(before).bitwiseOR(after).bitwiseAND(F.lit((1 << WORD) - 1))

        return F.transform(m, word)

    def high(m: Column) -> Column:
        return F.transform(m, lambda w, k: w.bitwiseOR(F.coalesce(F.get(m, k - across), F.lit(0).cast("long"))).bitwiseOR(F.coalesce(F.get(m, k + across), F.lit(0).cast("long"))))

    return bound(bound(mask, wide), high)


def opened_mask(valid: Column, mask: Column, across: Column) -> Column:
    """A packed mask after an opening by 3 by 3. What is eroded is what a spread of the gaps reaches; beyond the edge there are none."""

    def eroded(m: Column) -> Column:
        gaps = F.zip_with(valid, m, lambda v, w: v.bitwiseAND(F.bitwise_not(w)))
        return F.zip_with(m, _dilated(gaps, across), lambda w, g: w.bitwiseAND(F.bitwise_not(g)))

    return F.zip_with(valid, _dilated(bound(mask, eroded), across), lambda v, w: v.bitwiseAND(w))


def opened_counts(pixels: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Per frame and flag, the pixels that survive an opening: all flags in one pass over packed masks."""
    frames = packed(pixels, flags)
    ones = lambda mask: F.aggregate(mask, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
    return frames.select("video_id", "frame_number", *[ones(opened_mask(F.col("valid"), F.col(name), F.col("across"))).alias(name) for name in flags])


def coloured_counts(pixels: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per frame, the pixels in the green (VFX) and the orange (DI) range that survive an opening."""
    return opened_counts(with_hls(pixels), {"vfx_pixels": within(params.vfx_low, params.vfx_high), "di_pixels": within(params.di_low, params.di_high)})


def lut_enhanced(pixels: DataFrame, table: np.ndarray) -> DataFrame:
    """b, g and r through a colour table, between whose points values run straight; cut to 0..255.

    The table is indexed [r][g][b], or, of one dimension, [value] with a column a channel. It is broadcast (a usual one of
    33 points has 860 kB), and whole batches of pixels go through it at once;
    a pixel with a null channel is null.
    """
    held = pixels.sparkSession.sparkContext.broadcast(table)
    schema = ", ".join(f"`{f.name}` {'int' if f.name in ('b', 'g', 'r') else f.dataType.simpleString()}" for f in pixels.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgb = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in "rgb"], axis=-1) / 255
            unknown = np.isnan(rgb).any(axis=-1)
            out = np.floor(np.clip(looked_up(np.where(unknown[:, None], 0, rgb), held.value), 0, 1) * 255).astype(np.int32)
            made = {c: pa.array(out[:, k], pa.int32(), mask=unknown) for k, c in enumerate("rgb")}
            yield pa.record_batch([made.get(c, batch[c]) for c in batch.schema.names], batch.schema.names)

    return pixels.mapInArrow(run, schema)


def frame_hls(bgr: np.ndarray) -> np.ndarray:
    """The same for a frame (height, width, 3) of bytes."""
    b, g, r = (bgr[..., k].astype(np.float64) / 255 for k in range(3))
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    wide = top - low
    light = (top + low) / 2
    safe = np.where(wide == 0, 1, wide)
    vivid = np.where(wide == 0, 0, np.where(light < 0.5, wide / np.where(top + low == 0, 1, top + low), wide / np.where(2 - top - low == 0, 1, 2 - top - low)))
    turn = np.where(top == r, 60 * (g - b) / safe, np.where(top == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    turn = np.where(wide == 0, 0, np.where(turn < 0, turn + 360, turn))
    return np.rint(np.stack([turn / 2, light * 255, vivid * 255], axis=-1)).astype(np.uint8)


def frame_opened(mask: np.ndarray) -> np.ndarray:
    out = mask.astype(bool)
    for fill, fold in ((True, np.logical_and), (False, np.logical_or)):
        for axis in (0, 1):
            edge = np.pad(out, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], constant_values=fill)
            n = out.shape[axis]
            parts = [np.take(edge, range(k, k + n), axis=axis) for k in range(3)]
            out = fold(fold(parts[0], parts[1]), parts[2])
    return out


def frame_hits(bgr: np.ndarray, params: Params = DEFAULT, masked: bool = True) -> list[tuple[str, int, np.ndarray]]:
    """Type, pixel count and region of each colour that a frame has enough of: green first. Other pixels of a masked region are black."""
    height, width = bgr.shape[:2]
    roi = bgr[: int(height * params.roi_height), int(width * params.roi_left) :]
    if not roi.size:
        return []
    colours = frame_hls(roi)
    out = []
    for kind, low, high in (("VFX", params.vfx_low, params.vfx_high), ("DI", params.di_low, params.di_high)):
        mask = frame_opened(((colours >= low) & (colours <= high)).all(axis=-1))
        if (n := int(mask.sum())) > params.min_pixels:
            out.append((kind, n, np.where(mask[..., None], roi, 0).astype(np.uint8) if masked else np.ascontiguousarray(roi)))
    return out


def looked_up(rgb: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Values from 0 to 1 through a table: indexed [r][g][b], or [value], with a column a channel. Between its points values run straight."""
    size = table.shape[0]
    place = np.clip(rgb, 0, 1) * (size - 1)
    low = np.minimum(place.astype(np.int64), size - 2)
    part = (place - low)[..., None]
    if table.ndim == 2:
        channel = np.arange(3)
        return table[low, channel] * (1 - part[..., 0]) + table[low + 1, channel] * part[..., 0]
    r, g, b = (low[..., k] for k in range(3))
    along = {(dg, db): table[r, g + dg, b + db] * (1 - part[..., 0, :]) + table[r + 1, g + dg, b + db] * part[..., 0, :] for dg in (0, 1) for db in (0, 1)}
    flat = {db: along[0, db] * (1 - part[..., 1, :]) + along[1, db] * part[..., 1, :] for db in (0, 1)}
    return flat[0] * (1 - part[..., 2, :]) + flat[1] * part[..., 2, :]


def frame_lut(bgr: np.ndarray, tables: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """A frame through a colour table, or several one after another."""
    rgb = bgr[..., ::-1].astype(np.float32) / 255
    for table in [tables] if isinstance(tables, np.ndarray) else tables:
        rgb = looked_up(rgb, table)
    return (np.clip(rgb, 0, 1) * 255).astype(np.uint8)[..., ::-1]


def images_enhanced(rows: DataFrame, table: np.ndarray | list[np.ndarray]) -> DataFrame:
    """``image_bytes`` of shape ``image_shape`` through a colour table; an image that cannot be stays as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, shape in zip(batch["image_bytes"].to_pylist(), batch["image_shape"].to_pylist(), strict=True):
                try:
                    out.append(frame_lut(np.frombuffer(data, np.uint8).reshape(shape["h"], shape["w"], shape["c"]), table).tobytes())
                except (TypeError, ValueError):
                    out.append(data)
            yield batch.set_column(batch.schema.get_field_index("image_bytes"), "image_bytes", pa.array(out, pa.binary()))

    return rows.mapInArrow(run, rows.schema)

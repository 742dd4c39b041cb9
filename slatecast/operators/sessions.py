"""Sessions of detections over consecutive frames, and the merging of near-duplicates.

A session can only go on while frames follow closely and the type stays, which neighbours alone decide; that cuts each
video into segments, found within blocks of frames that also have the last few frames of the block before. Within a
segment the rest depends on the session's first row, so rows are folded in order: one pass over a sorted partition,
holding one row of state, however long the segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatecast.functions.text import similarity
from slatecast.operators.detections import best_exact, best_in_band
from slatecast.params import DEFAULT, Params

_SIDES = ("x1", "y1", "x2", "y2")


def overlap(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """Intersection over union of two boxes, for the folds."""
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if wide <= 0 or high <= 0:
        return 0.0
    shared = float(wide * high)
    joint = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / joint if joint > 0 else 0.0


def alike(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


#: Frames of a block, which is cut into segments in one task.
BLOCK = 4096


def segmented(rows: DataFrame, reach: float, goes_on: Callable[[Column], Column], columns: list[str], name: str = "segment", order: str = "rid", block: int = BLOCK, **more: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with the number, from 1, of its segment in its video, and ``more`` columns made of the row before.

    In the order of frames a row begins a segment if the row before is more than ``reach`` frames away, or if
    ``goes_on(columns of the row before)`` does not hold. Rows of a block's last ``reach`` frames are shown to the next
    block, too; a row that has none so near before it begins a segment anyway. Segments that begin in a block are
    counted in it, and those of the blocks before are added.
    """
    frame, width = F.col("frame_number"), max(block, int(reach) + 1)
    own = F.floor(frame / width)
    seen_in = F.when(frame - own * width >= width - reach, F.array(own, own + 1)).otherwise(F.array(own))
    inside = Window.partitionBy("video_id", "_block").orderBy("frame_number", order)
    before = F.lag(F.struct("frame_number", *columns)).over(inside)
    shown = rows.withColumn("_block", F.explode(seen_in)).withColumn("_before", before).where(F.col("_block") == own)
    near = frame - F.col("_before")["frame_number"] <= reach
    begins = ~F.coalesce(near & goes_on(F.col("_before")), F.lit(False))
    marked = shown.withColumns({"_begins": begins.cast("long"), **{c: make(F.when(near, F.col("_before"))) for c, make in more.items()}}).drop("_before")
    counts = marked.groupBy("video_id", "_block").agg(F.sum("_begins").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("video_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    base = counts.select("video_id", "_block", F.coalesce(earlier, F.lit(0)).alias("_base"))
    numbered = marked.withColumn(name, F.sum("_begins").over(inside)).join(base, ["video_id", "_block"])
    return numbered.withColumn(name, F.col(name) + F.col("_base")).drop("_begins", "_block", "_base")


def anchored_groups(rows: DataFrame, max_gap: int = 3, iou: float = DEFAULT.iou, same_text: float = DEFAULT.same_text) -> DataFrame:
    """``rows`` with ``segment`` and ``group_id``, unique within a video.

    In order of frames (then ``rid``) a row joins the session before it if the gap to the last row is at most
    ``max_gap``, the type is the same, and either the box overlaps that of the session's first row or the text is like
    that of its last.
    """
    kin = lambda before: F.coalesce(similarity(before["text"], F.col("text")), F.lit(0.0))
    marked = segmented(rows, max_gap, lambda before: before["text_type"] == F.col("text_type"), ["text_type", "text"], _kin=kin)
    dealt = marked.repartition("video_id", "segment").sortWithinPartitions("video_id", "segment", "frame_number", "rid")
    schema = T.StructType([*(f for f in marked.schema if f.name != "_kin"), T.StructField("group_id", T.LongType())])
    names = [f.name for f in schema if f.name != "group_id"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        anchor: tuple[int, ...] = ()
        group = 0
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in ("video_id", "segment", "rid", "_kin", *_SIDES)]
            for video, segment, rid, kin, *box in zip(*columns, strict=True):
                if held != (video, segment) or (kin < same_text and overlap(anchor, tuple(box)) < iou):
                    held, anchor, group = (video, segment), tuple(box), rid
                out.append(group)
            yield pa.record_batch([*(batch[c] for c in names), pa.array(out, pa.int64())], [*names, "group_id"])

    return dealt.mapInArrow(fold, schema)


def continuous_sessions(rows: DataFrame, max_gap: int = 3, params: Params = DEFAULT) -> DataFrame:
    """The best row of each anchored session of enough rows, at the frame where the session begins."""
    groups = anchored_groups(rows, max_gap, params.iou, params.same_text)
    over = Window.partitionBy("video_id", "group_id")
    grown = groups.withColumns({"_n": F.count(F.lit(1)).over(over), "_start": F.min("frame_number").over(over)}).where(F.col("_n") >= params.min_rows)
    best = best_in_band(grown, ["video_id", "group_id"], params.band)
    return best.withColumn("frame_number", F.col("_start")).drop("_n", "_start", "segment")


def gap_sessions(rows: DataFrame, seconds: float = 1.0, fps: float = 25.0) -> DataFrame:
    """The best row of each run of rows of one type, none later than so many seconds after the one before."""
    grouped = segmented(rows, seconds * fps, lambda before: before["text_type"] == F.col("text_type"), ["text_type"], "group_id")
    return best_exact(grouped, ["video_id", "group_id"])


def merged_groups(rows: DataFrame, params: Params = DEFAULT, order: str = "rid") -> DataFrame:
    """``rows`` with ``leader``: the ``order`` value of the row that each belongs to.

    In that order a row joins the first leader of its type that is alike and at most so many frames away, else it leads.
    No two rows can be joined over a gap of more frames, so segments between such gaps are worked on apart; in one,
    leaders are found by their type and block of frames, so a long segment costs no more a row than a short one.
    """
    marked = segmented(rows, params.merge_frames, lambda before: F.lit(True), [], "_segment", order)
    dealt = marked.repartition("video_id", "_segment").sortWithinPartitions("video_id", "_segment", order)
    schema = T.StructType([*(f for f in rows.schema), T.StructField("leader", T.LongType())])
    names = rows.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        wide = params.merge_frames + 1
        leaders: dict[tuple[str, int], list[tuple[int, int, frozenset[str], int]]] = {}  # (nth, frame, letters, place)
        nth = 0
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in ("video_id", "_segment", order, "text_type", "frame_number", "text")]
            for video, segment, place, kind, frame, text in zip(*columns, strict=True):
                if held != (video, segment):
                    held, leaders, nth = (video, segment), {}, 0
                letters, block = frozenset(text.lower()), frame // wide
                near = (x for k in (block - 1, block, block + 1) for x in leaders.get((kind, k), ()))
                first = min((x for x in near if abs(x[1] - frame) <= params.merge_frames and alike(x[2], letters) > params.merge_text), default=None, key=lambda x: x[0])
                if first is None:
                    first = (nth, frame, letters, place)
                    leaders.setdefault((kind, block), []).append(first)
                    nth += 1
                out.append(first[3])
            yield pa.record_batch([*(batch[c] for c in names), pa.array(out, pa.int64())], [*names, "leader"])

    return dealt.mapInArrow(fold, schema)


def merge_similar(rows: DataFrame, params: Params = DEFAULT, order: str = "rid") -> DataFrame:
    """The best row of each merged group, with ``leader``, whose order is that of the result."""
    return best_exact(merged_groups(rows, params, order), ["video_id", "leader"])

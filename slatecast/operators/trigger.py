"""The older rule for when to read a caption, which depends on whether the last reading gave any text.

Of its branches only this can ever hold: at least 25 frames have passed since the last reading that gave text, and either
ten seconds have or the count of pixels moved by more than three tenths; and five hits were seen.

Readings feed back, so hits would have to be folded in order, a video in one task. But after a reading at a hit, the next
that gives text is at a hit that only these two and those between them decide, ten seconds on at most but for gaps. So
every hit has one successor, found within its block of frames and the beginning of the next. Within a block the
successors are followed to where they leave it; between blocks, by pointers of doubled length, from the first reading on.
That tells with which last reading each block begins, and then all blocks are folded apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatecast.functions.dealing import dealt
from slatecast.sources.files import written

HISTORY, LEAST_FRAMES, SECONDS, CHANGE = 5, 25, 10, 0.3
#: Frames of a block; at least as many as may pass between readings.
BLOCK = 4096

_KEY = ["video_id", "text_type"]


def triggered(hits: DataFrame, fps: float = 25.0, readable: str | None = None, block: int = BLOCK) -> DataFrame:
    """The hits at which a caption is read.

    ``hits`` has video_id, text_type, frame_number and pixel_count, one row a frame of each video and type; ``readable``
    names a boolean column that says whether a reading there would give text (always, by default; null is no). Frames are
    counted from 0 for each video and type.
    """
    most = int(SECONDS * fps)
    block = max(block, most)
    works = F.coalesce(F.col(readable), F.lit(False)) if readable else F.lit(True)
    marks = written(hits.select(*_KEY, F.floor(F.col("frame_number") / block).alias("_block"), F.col("frame_number").alias("frame"), F.col("pixel_count").cast("long").alias("count"), works.alias("works")))
    blocks = written(_blocks(marks, block, most))
    steps = written(_steps(marks, blocks, block, most))
    first = marks.where("works").join(blocks.where(f"before < {HISTORY}").select(*_KEY, "_block", "before", "frames"), [*_KEY, "_block"], "left")
    place = F.array_position("frames", F.col("frame"))  # 0 if it is not among the block's first
    seen = F.when(place > 0, F.col("before") + place).otherwise(HISTORY)
    first = first.where((seen >= HISTORY) & (F.col("frame") >= LEAST_FRAMES) & ((F.col("frame") >= most) | (F.abs("count") > 0))).groupBy(*_KEY).agg(F.min("frame").alias("frame"))
    begun = _reached(steps, first)
    left = steps.join(begun, [*_KEY, "frame"], "left_semi").select(*_KEY, "_block", F.struct("exit_frame", "exit_count").alias("exit"))
    earlier = Window.partitionBy(*_KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("exit", ignorenulls=True).over(earlier)  # of a table with a row a block
    states = blocks.join(left, [*_KEY, "_block"], "left").select(*_KEY, "_block", F.col("before").alias("_seen"), F.coalesce(last["exit_frame"], F.lit(0)).alias("_frame"), F.coalesce(last["exit_count"], F.lit(0)).alias("_count"))
    return _folded(hits.withColumn("_block", F.floor(F.col("frame_number") / block)).join(states, [*_KEY, "_block"]), hits, most, readable)


def _due(waited: np.ndarray | int, count: np.ndarray | int, last: int, most: int) -> np.ndarray | bool:
    return (waited >= LEAST_FRAMES) & ((waited >= most) | (abs(count - last) > CHANGE * last))


def _blocks(marks: DataFrame, block: int, most: int) -> DataFrame:
    """A row a block: the hits before it, its first few frames, and the first readable frame further on that is due in any case."""
    late = F.col("frame") - F.col("_block") * block >= most
    rows = marks.groupBy(*_KEY, "_block").agg(
        F.count(F.lit(1)).alias("n"),
        F.slice(F.array_sort(F.collect_list("frame")), 1, HISTORY).alias("frames"),
        F.min(F.when(F.col("works"), F.col("frame"))).alias("readable"),
        F.min(F.when(F.col("works") & late, F.col("frame"))).alias("late"),
    )
    by_block = Window.partitionBy(*_KEY).orderBy("_block")
    before = F.coalesce(F.sum("n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    further = F.coalesce(F.first("late", ignorenulls=True).over(by_block.rangeBetween(1, 1)), F.first("readable", ignorenulls=True).over(by_block.rangeBetween(2, Window.unboundedFollowing)))
    return rows.select(*_KEY, "_block", before.alias("before"), "frames", further.alias("further"))


def _steps(marks: DataFrame, blocks: DataFrame, block: int, most: int) -> DataFrame:
    """``(…, _block, frame, exit_frame, exit_count, to)``: for a reading at each hit the last one in its block, and the first beyond."""
    ahead = marks.where(F.col("frame") - F.col("_block") * block < most).withColumns({"_block": F.col("_block") - 1, "own": F.lit(False)})
    rows = marks.withColumn("own", F.lit(True)).unionByName(ahead).join(blocks.select(*_KEY, "_block", "further"), [*_KEY, "_block"])

    def follow(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        frame, count, works, own = (table[c].to_numpy() for c in ("frame", "count", "works", "own"))
        further = table["further"][0].as_py()
        n = len(frame)
        after = np.full(n + 1, n)  # the first readable row from each on
        for k in range(n - 1, -1, -1):
            after[k] = k if works[k] else after[k + 1]
        low, high = np.searchsorted(frame, frame + LEAST_FRAMES), np.searchsorted(frame, frame + most)
        leave, to = np.arange(n), [None] * n
        for j in range(int(own.sum()) - 1, -1, -1):
            near = np.flatnonzero(works[low[j] : high[j]] & (np.abs(count[low[j] : high[j]] - count[j]) > CHANGE * count[j]))
            k = low[j] + near[0] if len(near) else after[high[j]]
            if k < n and own[k]:
                leave[j], to[j] = leave[k], to[k]
            else:
                to[j] = int(frame[k]) if k < n else further
        mine = np.flatnonzero(own)
        made = [pa.array(x) for x in (frame[mine], frame[leave[mine]], count[leave[mine]])]
        same = [pa.array([k.as_py()] * len(mine), kind) for k, kind in zip(key, (pa.string(), pa.string(), pa.int64()), strict=True)]
        return pa.table([*same, *made, pa.array([to[k] for k in mine], pa.int64())], [*_KEY, "_block", "frame", "exit_frame", "exit_count", "to"])

    kinds = "video_id string, text_type string, _block long, frame long, exit_frame long, exit_count long, to long"
    return rows.groupBy(*_KEY, "_block").applyInArrow(follow, kinds)


def _reached(steps: DataFrame, first: DataFrame) -> DataFrame:
    """The frames at which the readings from ``first`` on come into a block."""
    entries = steps.where("to is not null").select(*_KEY, F.col("to").alias("frame")).unionByName(first).distinct()
    jumps = written(steps.where("to is not null").join(entries, [*_KEY, "frame"], "left_semi").select(*_KEY, "frame", "to"))
    lengths = []
    while not jumps.isEmpty():
        lengths.append(jumps)
        jumps = written(jumps.join(jumps.select(*_KEY, F.col("frame").alias("to"), F.col("to").alias("end")), [*_KEY, "to"]).select(*_KEY, "frame", F.col("end").alias("to")))
    reached = first
    for jumps in reversed(lengths):
        reached = written(reached.unionByName(reached.join(jumps, [*_KEY, "frame"]).select(*_KEY, F.col("to").alias("frame"))))
    return reached


def _folded(rows: DataFrame, hits: DataFrame, most: int, readable: str | None) -> DataFrame:
    """Each block from its own beginning: ``_seen`` hits before it, and the last reading at ``_frame`` with ``_count``."""
    by_block = dealt(rows, *_KEY, "_block").sortWithinPartitions(*_KEY, "_block", "frame_number")
    names = hits.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        seen = last_count = last_frame = 0
        for batch in batches:
            keep = []
            reads = batch[readable].to_pylist() if readable else [True] * batch.num_rows
            columns = (batch[c].to_pylist() for c in (*_KEY, "_block", "_seen", "_frame", "_count", "frame_number", "pixel_count"))
            for video, kind, block, before, frame0, count0, frame, count, works in zip(*columns, reads, strict=True):
                if held != (video, kind, block):
                    held, seen, last_frame, last_count = (video, kind, block), before, frame0, count0
                seen += 1
                due = seen >= HISTORY and bool(_due(frame - last_frame, count, last_count, most))
                keep.append(due)
                if due and works:
                    last_frame, last_count = frame, count
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return by_block.mapInArrow(fold, hits.schema)

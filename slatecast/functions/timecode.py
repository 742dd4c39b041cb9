"""Frames and SMPTE time codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_to_smpte(frame: Column, fps: float = 25.0) -> Column:
    """``HH:MM:SS:FF``: FF is rounded half to even and not carried, hours go on beyond 99, no frames are dropped."""
    t = frame.cast("double") / F.lit(float(fps))
    whole = F.floor(t)
    return F.format_string(
        "%02d:%02d:%02d:%02d",
        F.floor(t / 3600),
        F.floor((t % 3600) / 60),
        F.floor(t % 60),
        F.rint((t - whole) * fps).cast("long"),
    )


def time_to_frame(code: Column, fps: float = 25.0, strict: bool = False) -> Column:
    """The frame of SS, MM:SS, HH:MM:SS or HH:MM:SS:FF; an empty code is frame 0.

    Seconds are cut to whole frames, FF is added as it stands. Anything else is null, or an error if ``strict``.
    """
    parts = F.split(code, ":")
    number = F.transform(parts, lambda p: F.try_to_number(p, F.lit("999999999999")).cast("long"))
    n = F.size(parts)

    def at(k: int) -> Column:
        return F.try_element_at(number, F.lit(k))

    seconds = (
        F.when(n == 1, at(1)).when(n == 2, at(1) * 60 + at(2)).when((n == 3) | (n == 4), at(1) * 3600 + at(2) * 60 + at(3))
    )
    frames = (seconds * F.lit(float(fps))).cast("long") + F.when(n == 4, at(4)).otherwise(F.lit(0))
    out = F.when(code == "", F.lit(0).cast("long")).otherwise(frames)
    return F.when(code.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("not a time code: "), code)).cast("long")).otherwise(out) if strict else out


def time_range(start: int, end: int, count: int) -> tuple[int, int]:
    """Clamp a range of frames to a video of ``count`` frames; an empty range is an error."""
    start = 0 if start >= count else start
    end = min(end, count)
    if start >= end:
        raise ValueError(f"the range from {start} to {end} is empty")
    return start, end


def percent(done: Column, total: Column) -> Column:
    """Two decimals of the exact binary value, ties to even."""
    return F.replace(F.format_number(done / total * 100, 2), F.lit(","), F.lit(""))

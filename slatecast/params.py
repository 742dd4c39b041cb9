"""Parameters of detection and post-processing, with the usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    fps: float = 25.0
    roi_height: float = 0.06  # the region is the rows above this share of the height
    roi_left: float = 0.40  # and the columns right of this share of the width
    vfx_low: tuple[int, int, int] = (45, 106, 138)  # hue, lightness, saturation, both ends included
    vfx_high: tuple[int, int, int] = (75, 195, 255)
    di_low: tuple[int, int, int] = (10, 106, 75)
    di_high: tuple[int, int, int] = (25, 160, 245)
    min_pixels: int = 680  # more than so many pixels make a hit
    min_confidence: float = 0.1
    max_gap: int = 12
    iou: float = 0.8
    same_text: float = 0.8  # at least so, within a session
    merge_text: float = 0.8  # more than so, to merge
    merge_frames: int = 25
    min_rows: int = 10
    band: float = 0.01


DEFAULT = Params()

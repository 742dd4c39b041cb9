"""A made-up video for tests and examples: caption bars that come and go, no file needed."""

from __future__ import annotations

import numpy as np


class SyntheticDecoder:
    """600 frames of 320 by 200 at 25 a second. A green bar shows for 80 frames of every 120, an orange one for 60 of every 150."""

    def __init__(self, path: str, options: dict[str, str]) -> None:
        self.width, self.height, self.fps = 320, 200, 25.0
        self.frame_count = int(options.get("frame_count", 600))

    def read(self, frame: int) -> bytes | None:
        if not 0 <= frame < self.frame_count:
            return None
        image = np.full((self.height, self.width, 3), 40, np.uint8)
        if frame % 120 < 80:
            image[1:11, 140:220] = (60, 230, 70)  # blue, green, red
        if frame % 150 < 60:
            image[1:11, 230:310] = (40, 130, 230)
        return image.tobytes()

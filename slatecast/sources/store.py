"""Markers that are kept: a table on a shared file system, changed timeline by timeline.

A change writes whole timelines anew, as files beside the old ones, and becomes what readers see by one entry in a log: a
file that only one writer can make. An entry names, for each timeline, the folder with its rows. A writer that finds the
log grown meanwhile goes on where others changed other timelines, and fails where they changed its own, as what it wrote
was derived from rows that no longer hold. Whoever reads keeps the version it opened.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatecast.operators import markers as m
from slatecast.sources.files import written


class Conflict(RuntimeError):
    """Another writer changed the same timelines first."""


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[str, str]


class MarkerStore:
    """A table of markers in the folder ``path``, which the driver and all executors reach; no version means no markers."""

    SCHEMA = f"timeline_id string, {m.SCHEMA}"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, Path(path)
        (self.path / "log").mkdir(parents=True, exist_ok=True)

    def version(self) -> Version:
        entries = sorted((self.path / "log").glob("*.json"))
        return Version(int(entries[-1].stem), json.loads(entries[-1].read_text(encoding="utf-8"))) if entries else Version(0, {})

    def read(self, timelines: list[str] | None = None, version: Version | None = None) -> DataFrame:
        """The markers of some timelines, or of all; only their folders are opened."""
        folders = (version or self.version()).folders
        chosen = sorted(folders[t] for t in folders if timelines is None or t in timelines)
        if not chosen:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[str(self.path / folder) for folder in chosen])

    def change(self, make: Callable[[DataFrame], DataFrame], timelines: list[str], tries: int = 10) -> Version:
        """Put ``make(markers)`` of these timelines in place of their markers; rows of other timelines are an error.

        Only these timelines are read and written. A timeline without markers is gone.
        """
        base = self.version()
        new = written(make(self.read(timelines, base)).select(*[c.split()[0] for c in self.SCHEMA.split(", ")]))
        kept = [r["timeline_id"] for r in new.select("timeline_id").distinct().collect()]  # names of the changed timelines
        if not set(kept) <= set(timelines):
            raise ValueError(f"rows of other timelines than {timelines}")
        folders = {t: f"data/{quote(t, safe='')}/{uuid.uuid4().hex}" for t in kept}
        for t, folder in folders.items():
            new.where(F.col("timeline_id") == t).orderBy("frame_id").write.parquet(str(self.path / folder))
        for _ in range(tries):
            now = self.version()
            if any(now.folders.get(t) != base.folders.get(t) for t in timelines):
                raise Conflict(f"timelines {timelines} were changed by version {now.number}")
            done = Version(now.number + 1, {t: f for t, f in now.folders.items() if t not in timelines} | folders)
            if self._entered(done):
                return done
        raise Conflict(f"no place in the log after {tries} tries")

    def _entered(self, version: Version) -> bool:
        """Whether the entry was made by this writer; a file system makes a link only where there is nothing."""
        half = self.path / "log" / f"{uuid.uuid4().hex}.half"
        half.write_text(json.dumps(version.folders, ensure_ascii=False), encoding="utf-8")
        try:
            os.link(half, self.path / "log" / f"{version.number:020d}.json")
            return True
        except FileExistsError:
            return False
        finally:
            half.unlink()

    def add(self, new: DataFrame, timelines: list[str]) -> DataFrame:
        """Add markers, and give those that were refused, as their frame was taken."""
        base = self.version()
        refused = written(m.added(self.read(timelines, base), new)[1])
        self.change(lambda old: m.added(old, new)[0], timelines)
        return refused

    def delete_frame(self, frame: float, timelines: list[str]) -> Version:
        return self.change(lambda old: m.without_frame(old, frame), timelines)

    def delete_custom_data(self, value: str, timelines: list[str]) -> Version:
        """The first marker of each timeline that bears the value goes."""
        return self.change(lambda old: m.without_first_custom_data(old, value), timelines)

    def delete_colour(self, name: str, timelines: list[str]) -> Version:
        return self.change(lambda old: m.without_colour(old, name), timelines)

    def clear_range(self, start: float, end: float, timelines: list[str]) -> Version:
        return self.change(lambda old: m.without_range(old, start, end), timelines)

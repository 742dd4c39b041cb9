"""Markers of a timeline that is open in a video editor.

``Timeline`` is what an editor's scripting interface must offer; ``MemoryTimeline`` does so without an editor, and
``connect`` finds the open one through a scripting object.
"""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from slatecast.operators import markers as m

RAW = "timeline_id string, " + m.SCHEMA


class Timeline(Protocol):
    def GetMarkers(self) -> dict[float, dict[str, Any]]: ...  # noqa: N802  names as the scripting interface has them

    def AddMarker(self, frame: float, color: str, name: str, note: str, duration: float, custom: str) -> bool: ...  # noqa: N802

    def DeleteMarkerAtFrame(self, frame: float) -> bool: ...  # noqa: N802


class MemoryTimeline:
    """A timeline held in memory; a frame bears one marker."""

    def __init__(self) -> None:
        self.held: dict[float, dict[str, Any]] = {}

    def GetMarkers(self) -> dict[float, dict[str, Any]]:  # noqa: N802
        return dict(self.held)

    def AddMarker(self, frame: float, color: str, name: str, note: str, duration: float, custom: str) -> bool:  # noqa: N802
        if frame in self.held:
            return False
        self.held[frame] = {"color": color, "name": name, "note": note, "duration": duration, "customData": custom}
        return True

    def DeleteMarkerAtFrame(self, frame: float) -> bool:  # noqa: N802
        return self.held.pop(frame, None) is not None


def _or_fail(found: Any, what: str) -> Any:
    if not found:
        raise ConnectionError(f"the editor has no {what}")
    return found


class Connection:
    """The open project of an editor; each thing that is missing is a ConnectionError that names it."""

    def __init__(self, editor: Any) -> None:
        manager = _or_fail(_or_fail(editor, "scripting access").GetProjectManager(), "project manager")
        self.project = _or_fail(manager.GetCurrentProject(), "open project")

    @property
    def project_name(self) -> str:
        return self.project.GetName()

    @property
    def timeline(self) -> Timeline:
        return _or_fail(self.project.GetCurrentTimeline(), "open timeline")

    @property
    def media_pool(self) -> Any:
        return _or_fail(self.project.GetMediaPool(), "media pool")


def read_timeline(spark: SparkSession, timeline: Timeline, timeline_id: str = "t0") -> DataFrame:
    """The timeline's markers as the other operators take them; any failure to get them is a ConnectionError."""
    try:
        found = timeline.GetMarkers() or {}
        rows = [(timeline_id, float(frame), *(x.get(c) for c in ("color", "name", "note")), None if x.get("duration") is None else float(x["duration"]), x.get("customData")) for frame, x in found.items()]
    except Exception as error:
        raise ConnectionError(f"the timeline's markers could not be read: {error}") from error
    return m.stored(spark.createDataFrame(rows, RAW))


def write_timeline(markers: DataFrame, timeline: Timeline) -> tuple[int, int]:
    """How many markers the editor took and refused; they go there one by one, in the order of frames, as it has no other way."""
    taken = refused = 0
    for r in markers.select(*m.FIELDS).orderBy("frame_id").toLocalIterator():
        done = timeline.AddMarker(r["frame_id"], r["color"], r["name"], r["note"], r["duration"], r["custom_data"])
        taken, refused = taken + bool(done), refused + (not done)
    return taken, refused

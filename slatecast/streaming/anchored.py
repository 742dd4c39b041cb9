"""The whole post-processing of detections that are still coming in: anchored sessions, and the merging of near-duplicates.

Each video is a key. Its rows wait until the watermark has passed them, as nothing can then come in before them, and are
folded in the order of frames, just as the table's are: the state has the open session's first box and last row, and the
leaders that later sessions may still join. Event-time timers tell when rows can be folded, when the gap that closes a
session has passed, and when no session to come can join a leader, whose group's best row then comes out. What comes later
than the watermark cannot change what is out; Spark drops it and counts it, see ``late_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from slatecast.functions.text import strip
from slatecast.operators.detections import confident
from slatecast.operators.sessions import alike, overlap
from slatecast.params import DEFAULT, Params

_FIELDS = "rid long, frame_number long, text_type string, text string, pixel_count long, confidence double"
_ROW = f"{_FIELDS}, x1 int, y1 int, x2 int, y2 int, stripped int, at long"
_SESSION = "group_id long, n long, start long, last_frame long, last_text string, text_type string, x1 int, y1 int, x2 int, y2 int, top double"
_LEADER = f"leader long, leader_frame long, leader_text string, {_FIELDS}"
#: What comes out: of each merged group the best row, at the frame where its session begins.
SCHEMA = f"video_id string, {_FIELDS}, leader long"

_NAMES = [c.split()[0] for c in _FIELDS.split(", ")]


@dataclass
class Clock:
    """Frames as event time, in microseconds; the first is a second after the epoch, at which a stream's watermark begins."""

    fps: float

    def at(self, frame: int) -> int:
        return 1_000_000 + int(frame * 1_000_000 / self.fps)


class AnchoredSessions(StatefulProcessor):
    """One video's rows, session and leaders."""

    def __init__(self, params: Params = DEFAULT, max_gap: int | None = None) -> None:
        self.params, self.clock = params, Clock(params.fps)
        self.max_gap = params.max_gap if max_gap is None else max_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.session = handle.getValueState("session", _SESSION)
        self.band = handle.getListState("band", _ROW)  # the open session's rows that may be its best
        self.leaders = handle.getListState("leaders", _LEADER)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001
        new = [tuple(r[c.split()[0]] for c in _ROW.split(", ")) for r in rows]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[-1] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        names = [c.split()[0] for c in _ROW.split(", ")]
        waiting = [dict(zip(names, r, strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in waiting if r["at"] <= passed), key=lambda r: (r["frame_number"], r["rid"]))
        rest = [r for r in waiting if r["at"] > passed]
        session = self.session.get()
        session = dict(zip([c.split()[0] for c in _SESSION.split(", ")], session, strict=True)) if session is not None else None
        band = [dict(zip(names, r, strict=True)) for r in self.band.get()] if self.band.exists() else []
        leaders = [dict(zip([c.split()[0] for c in _LEADER.split(", ")], r, strict=True)) for r in self.leaders.get()] if self.leaders.exists() else []
        for row in ready:
            if session is not None and not self._goes_on(session, row):
                self._merge(leaders, session, band)
                session = None
            if session is None:
                session, band = self._opened(row), []
            self._take(session, row)
            band = [r for r in [*band, row] if abs(r["confidence"] - session["top"]) < self.params.band]
        if session is not None and self.clock.at(session["last_frame"] + self.max_gap) <= passed:
            self._merge(leaders, session, band)
            session, band = None, []
        # of the sessions to come none begins before the open one, or before what the watermark has passed
        out = [x for x in leaders if (self.clock.at(x["leader_frame"] + self.params.merge_frames) < self.clock.at(session["start"]) if session else self.clock.at(x["leader_frame"] + self.params.merge_frames) <= passed)]
        leaders = [x for x in leaders if x not in out]
        self._keep(rest, session, band, leaders, passed)
        for x in sorted(out, key=lambda x: x["leader"]):
            yield Row(video_id=key[0], **{c: x[c] for c in _NAMES}, leader=x["leader"])

    def close(self) -> None:
        pass

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def _keep(self, waiting: list[dict], session: dict | None, band: list[dict], leaders: list[dict], passed: int) -> None:
        for state, rows in ((self.waiting, waiting), (self.band, band), (self.leaders, leaders)):
            if rows:
                state.put([tuple(r.values()) for r in rows])
            else:
                state.clear()
        if session is None:
            self.session.clear()
        else:
            self.session.update(tuple(session.values()))
        wakes = [r["at"] for r in waiting]
        if session is not None:
            wakes.append(self.clock.at(session["last_frame"] + self.max_gap))
        else:
            wakes += [self.clock.at(x["leader_frame"] + self.params.merge_frames) for x in leaders]
        if wakes:
            self._wake(max(min(wakes), passed))

    def _goes_on(self, session: dict, row: dict) -> bool:
        """Whether a row joins the session: the rule of ``operators.sessions.anchored_groups``."""
        if row["frame_number"] - session["last_frame"] > self.max_gap or row["text_type"] != session["text_type"]:
            return False
        kin = alike(frozenset(session["last_text"].lower()), frozenset(row["text"].lower()))
        sides = ("x1", "y1", "x2", "y2")
        return kin >= self.params.same_text or overlap(tuple(session[s] for s in sides), tuple(row[s] for s in sides)) >= self.params.iou

    @staticmethod
    def _opened(row: dict) -> dict:
        return {"group_id": row["rid"], "n": 0, "start": row["frame_number"], "last_frame": row["frame_number"], "last_text": "", "text_type": row["text_type"], **{s: row[s] for s in ("x1", "y1", "x2", "y2")}, "top": row["confidence"]}

    @staticmethod
    def _take(session: dict, row: dict) -> None:
        session["n"] += 1
        session["last_frame"], session["last_text"] = row["frame_number"], row["text"]
        session["top"] = max(session["top"], row["confidence"])

    def _merge(self, leaders: list[dict], session: dict, band: list[dict]) -> None:
        """The closed session's best row joins the first leader that is alike and near, or leads."""
        if session["n"] < self.params.min_rows:
            return
        best = min(band, key=lambda r: (-r["stripped"], r["frame_number"], r["rid"]))
        row = {c: best[c] for c in _NAMES} | {"frame_number": session["start"]}
        letters = frozenset(row["text"].lower())
        for x in leaders:
            if x["text_type"] == row["text_type"] and abs(x["leader_frame"] - row["frame_number"]) <= self.params.merge_frames and alike(frozenset(x["leader_text"].lower()), letters) > self.params.merge_text:
                if (-row["confidence"], -row["pixel_count"], row["rid"]) < (-x["confidence"], -x["pixel_count"], x["rid"]):
                    x.update(row)
                return
        leaders.append({"leader": session["group_id"], "leader_frame": row["frame_number"], "leader_text": row["text"], **row})


def use_state_store(spark: SparkSession) -> None:
    """The state store that keyed state and timers need; a session's setting."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def postprocessed(detections: DataFrame, params: Params = DEFAULT, late_seconds: float = 10.0) -> DataFrame:
    """The rows of ``plans.postprocess`` (without ``timecode``) of a stream of raw detections, once nothing can change them.

    Frames count as time since the video's start. A row may be later than the watermark by one batch more, as Spark has it. The merging goes by where sessions begin.
    """
    use_state_store(detections.sparkSession)
    rows = confident(detections, params.min_confidence)
    at = (F.col("frame_number") * 1_000_000 / F.lit(params.fps)).cast("long") + 1_000_000
    columns = ["video_id", *_NAMES, "x1", "y1", "x2", "y2"]
    rows = rows.select(*[F.col(c).cast("long") if c == "pixel_count" else F.col(c) for c in columns], F.length(strip(F.col("text"))).cast("int").alias("stripped"), at.alias("at"))
    timed = rows.withColumn("_at", F.timestamp_micros("at")).withWatermark("_at", f"{int(late_seconds * 1000)} milliseconds")
    return timed.groupBy("video_id").transformWithState(AnchoredSessions(params), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def late_rows(query: StreamingQuery) -> int:
    """How many rows came too late, as far as the query's recent progress tells."""
    return sum(state.get("numRowsDroppedByWatermark", 0) for progress in query.recentProgress for state in progress["stateOperators"])

"""The queries of the annotation engine by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from slatecast.functions import geometry, text
from slatecast.functions.timecode import frame_to_smpte, percent, time_to_frame
from slatecast.operators import detections as d
from slatecast.operators import markers as m
from slatecast.operators import ocr, pixels, sessions, trigger
from slatecast.params import Params
from slatecast.plans import oracles as o
from slatecast.plans import views
from slatecast.plans.postprocess import postprocess
from slatecast.plans.video import detect, detect_legacy
from slatecast.sources import files
from slatecast.sources.frames import frame_numbers, frames_at, read_frames
from slatecast.sources.store import MarkerStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detections(spark, sf_dir).drop("k")


_ROW = ["rid", "frame_number", "text_type", "text", "pixel_count", "confidence"]


@_query(o.SMPTE)
def smpte_timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("frame_number")
    return _det(spark, sf_dir).select("rid", frame_to_smpte(f).alias("tc25"), frame_to_smpte(f, 29.97).alias("tc2997"), frame_to_smpte(f * 1000, 24.0).alias("tc_long"))


@_query(o.TIME_TO_FRAME)
def time_to_frame_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _det(spark, sf_dir).select("rid", F.split(frame_to_smpte(F.col("frame_number")), ":").alias("p"))
    codes = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.array_join(F.slice("p", F.lit(1), n), ":"))
    each = rows.select("rid", F.posexplode(codes).alias("parts", "code"))
    return each.select("rid", (F.col("parts") + 1).alias("parts"), time_to_frame(F.col("code")).alias("frame"), time_to_frame(F.col("code"), 23.976).alias("frame_film"))


@_query(o.normalize("VFX"))
def normalize_vfx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _det(spark, sf_dir).select("rid", text.repaired(F.col("text"), text.VFX).alias("text"))


@_query(o.normalize("DI"))
def normalize_di(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _det(spark, sf_dir).select("rid", text.repaired(F.col("text"), text.DI).alias("text"))


@_query(o.normalize(None, legacy=True))
def normalize_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _det(spark, sf_dir).select("rid", text.normalized(F.col("text"), F.col("text_type"), legacy=True).alias("text"))


@_query(o.FILTER)
def filter_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.confident(_det(spark, sf_dir)).select(*_ROW)


def _by_frame() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("frame_number", "rid")


@_query(o.SIMILARITY)
def text_similarity_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _det(spark, sf_dir).withColumn("before", F.lag("text").over(_by_frame())).where("before is not null").select("rid", text.similarity(F.col("before"), F.col("text")).alias("similarity"))


@_query(o.IOU)
def bbox_iou_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _det(spark, sf_dir).withColumn("box", views.box()).withColumn("before", F.lag("box").over(_by_frame()))
    return boxes.where("before is not null").select("rid", geometry.iou(F.col("before"), F.col("box")).alias("iou"))


@_query(o.PIXEL_THRESHOLD)
def pixel_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.over_threshold(_det(spark, sf_dir)).select("rid", "text_type", "pixel_count")


@_query(o.EVERY_OTHER)
def sample_every_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.every_other(d.over_threshold(_det(spark, sf_dir))).select("rid", "text_type")


def _two_colours(rows: DataFrame) -> DataFrame:
    """Some frames with hits of both colours: a third of the rows also give the other type."""
    other = rows.where("rid % 3 = 0").withColumn("text_type", F.when(F.col("text_type") == "VFX", "DI").otherwise("VFX"))
    return rows.unionByName(other)


@_query(o.ONE_COLOUR)
def color_priority_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.one_colour(_two_colours(d.over_threshold(_det(spark, sf_dir)))).select("rid", "frame_number", "text_type")


@_query(o.MOVING_MEAN)
def moving_avg_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.moving_mean(d.over_threshold(_det(spark, sf_dir))).select("rid", F.round("mean_pixels", 6).alias("mean_pixels"))


@_query(o.GAP_SESSIONS)
def dedup_time_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.gap_sessions(_det(spark, sf_dir), 0.08).select(*_ROW, "group_id")


@_query(o.GROUPS)
def continuous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.anchored_groups(d.confident(_det(spark, sf_dir)), 12).select("rid", "group_id")


@_query(o.SESSIONS)
def dedup_continuous_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.continuous_sessions(d.confident(_det(spark, sf_dir)), 12).select(*_ROW, "group_id")


@_query(o.MERGED)
def merge_similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.merge_similar(d.confident(_det(spark, sf_dir))).select(*_ROW, "leader")


@_query(o.FULL)
def full_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess(_det(spark, sf_dir)).select(*_ROW, "timecode", "leader")


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("rid") / 16))


@_query(o.BEST_BAND)
def best_of_group_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.best_in_band(_blocks(_det(spark, sf_dir)), ["block"], 0.05).select("block", *_ROW)


@_query(o.BEST_EXACT)
def best_of_group_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.best_exact(_blocks(_det(spark, sf_dir)).withColumn("confidence", F.round("confidence", 1)), ["block"]).select("block", *_ROW)


@_query(o.STATS)
def detection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.statistics(_det(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 9))


def _import_rows(rows: DataFrame) -> DataFrame:
    """Rows of text as a marker file has them, some of whose frames cannot be read."""
    broken = F.when(F.col("rid") % 7 == 3, F.concat(F.lit("n"), F.col("frame_number"))).when(F.col("rid") % 7 == 5, "").otherwise(F.concat(F.lit(" "), F.col("frame_number"), F.lit(".5 ")))
    kind = F.when(F.col("rid") % 11 == 0, F.lit(" MISC ")).when(F.col("rid") % 11 == 1, F.lit("")).otherwise(F.col("text_type"))
    return rows.select("rid", broken.alias("frame"), F.concat(F.lit("　 "), "text", F.lit(" ")).alias("note"), kind.alias("kind"))


@_query(o.IMPORT)
def marker_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.from_rows(_import_rows(_det(spark, sf_dir))).where("ok").select("frame_id", "color", "name", "note", "duration", "custom_data")


@_query(o.IMPORT_STATS)
def marker_import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.import_stats(m.from_rows(_import_rows(_det(spark, sf_dir))))


@_query(o.MARKER_STORE)
def marker_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers as a store holds them: some fields missing, and some frames written a second time."""
    mk = views.markers(spark, sf_dir)
    bare = F.col("custom_data").isin("c3", "c4")
    first = mk.withColumns({"color": F.when(~bare, F.col("color")), "duration": F.when(~bare, F.col("duration")), "at": F.lit(0)})
    again = mk.where("color = 'Blue'").withColumns({"note": F.lit(None).cast("string"), "custom_data": F.lit("again"), "at": F.lit(1)})
    return m.stored(first.unionByName(again), arrival="at")


@_query(o.MARKER_TABLE)
def marker_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of two timelines stored, changed one timeline at a time, and read again."""
    store = MarkerStore(spark, files.shared_path(spark, "markers"))
    mk = views.markers(spark, sf_dir).withColumn("timeline_id", F.when(F.col("frame_id") % 2 == 0, "even").otherwise("odd"))
    store.change(lambda none: none.unionByName(mk), ["even", "odd"])
    store.add(_new_markers(mk.where("timeline_id = 'even'")), ["even"])
    store.clear_range(100, 2000, ["odd"])
    store.delete_colour("blue", ["odd"])
    store.delete_custom_data("c42", ["even"])
    store.delete_frame(1.0, ["odd"])
    return store.read().select("timeline_id", "frame_id", "color", "name", "note", "custom_data")


@_query(o.DETECTIONS_CSV)
def detections_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result table written as one CSV file by many tasks, and all its columns read again, in the file's order."""
    path = files.shared_path(spark, "detections.csv")
    rows = _det(spark, sf_dir).withColumn("timecode", frame_to_smpte(F.col("frame_number"))).orderBy("rid")
    files.write_detections_csv(rows, path)
    return files.read_detections_csv(spark, path)


@_query(o.markers("SELECT frame_id, color, name, note, duration, custom_data FROM mk"))
def marker_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All markers written as a JSON file by many tasks, and read again."""
    path = files.shared_path(spark, "markers.json")
    files.write_marker_json(views.markers(spark, sf_dir), path)
    return files.read_marker_json(spark, path).select("frame_id", "color", "name", "note", "duration", "custom_data")


@_query(o.MARKER_CSV)
def marker_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result file imported as markers."""
    path = files.shared_path(spark, "detections.csv")
    files.write_detections_csv(_det(spark, sf_dir).withColumn("timecode", frame_to_smpte(F.col("frame_number"))).orderBy("rid"), path)
    return files.read_marker_csv(spark, path).select("frame_id", "color", "name", "note", "ok")


@_query(o.BASE_NAMES)
def base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of made-up files, and how far each row is on the way."""
    rows = _det(spark, sf_dir)
    path = F.concat(F.lit("/cut/"), "text_type", F.lit(".d/"), "video_id", F.lit("_"), F.col("rid").cast("string"), F.when(F.col("rid") % 3 == 0, ".tar.mov").when(F.col("rid") % 3 == 1, ".mp4").otherwise(""))
    return rows.select("rid", text.base_name(path).alias("base"), percent(F.col("pixel_count"), F.lit(1600)).alias("done"))


def _marker_query(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(views.markers(spark, sf_dir))

    query.__name__ = name
    _query(o.markers(sql))(query)


_marker_query("markers_sorted", m.in_order, "SELECT * FROM mk")
_marker_query("markers_tail5", m.last_ones, "SELECT * FROM (SELECT * FROM mk ORDER BY frame_id DESC LIMIT 5)")
_marker_query("markers_head5", lambda mk: m.in_order(mk).limit(5).withColumn("note", F.substring("note", 1, 50)), "SELECT * REPLACE (substr(note, 1, 50) AS note) FROM (SELECT * FROM mk ORDER BY frame_id LIMIT 5)")
_marker_query("markers_by_color", lambda mk: m.by_colour(mk, "Green"), "SELECT * FROM mk WHERE color = 'Green'")
_marker_query("marker_at_frame", lambda mk: m.at_frame(mk, 1.0), "SELECT * FROM mk WHERE frame_id = 1")
_marker_query("markers_custom_data", lambda mk: m.by_custom_data(mk, "c42"), "SELECT * FROM mk WHERE custom_data = 'c42'")
_marker_query("markers_in_range", lambda mk: m.in_range(mk, 100, 2000), "SELECT * FROM mk WHERE frame_id >= 100 AND frame_id <= 2000")
_marker_query("markers_clear_range", lambda mk: m.without_range(mk, 100, 2000), "SELECT * FROM mk WHERE NOT (frame_id >= 100 AND frame_id <= 2000)")
_marker_query("markers_clear_stats", lambda mk: m.cleared(mk, 100, 2000), "SELECT count(*) AS deleted, count(*) AS total_found FROM mk WHERE frame_id BETWEEN 100 AND 2000")
_marker_query("markers_delete_frame", lambda mk: m.without_frame(mk, 1.0), "SELECT * FROM mk WHERE frame_id <> 1")
_marker_query("markers_delete_custom_data", lambda mk: m.without_first_custom_data(mk, "c42"), "SELECT * FROM mk WHERE frame_id <> (SELECT coalesce(min(frame_id), -1) FROM mk WHERE custom_data = 'c42')")
_marker_query("markers_delete_color", lambda mk: m.without_colour(mk, "yellow"), "SELECT * FROM mk WHERE color <> 'Yellow'")
_marker_query("markers_delete_all", m.without_any, "SELECT * FROM mk WHERE false")
_marker_query("marker_color_counts", m.colour_counts, "SELECT color, count(*) AS n FROM mk GROUP BY color")


def _flat_summary(markers: DataFrame) -> DataFrame:
    s = m.summary(markers)
    return s.select("total_count", F.to_json("colors").alias("colors"), F.col("frame_range.min").alias("low"), F.col("frame_range.max").alias("high"), F.col("first.note").alias("first_note"), F.col("total_count").alias("listed"))


_marker_query(
    "marker_summary",
    _flat_summary,
    """SELECT count(*) AS total_count, (SELECT '{' || string_agg('"' || color || '":' || n, ',' ORDER BY color) || '}' FROM (SELECT color, count(*) AS n FROM mk GROUP BY color)) AS colors,
    min(frame_id) AS low, max(frame_id) AS high, arg_min(note, frame_id) AS first_note, count(*) AS listed FROM mk""",
)
_marker_query(
    "marker_color_normalize",
    lambda mk: mk.select("frame_id", m.colour(F.when(F.col("frame_id") % 3 == 0, F.upper("color")).when(F.col("frame_id") % 3 == 1, F.col("name")).otherwise("Teal")).alias("color")),
    """SELECT frame_id, CASE WHEN lower(c) IN ('green', 'orange', 'red', 'blue', 'cyan', 'magenta', 'yellow') THEN upper(c[1]) || lower(c[2:]) ELSE c END AS color
    FROM (SELECT frame_id, CASE frame_id % 3 WHEN 0 THEN upper(color) WHEN 1 THEN name ELSE 'Teal' END AS c FROM mk)""",
)


_marker_query("marker_lines", lambda mk: m.described(mk).select("frame_id", "line"), "SELECT frame_id, concat('Marker(frame=', frame_id, ', color=', color, ', name=', chr(39), name, chr(39), ')') AS line FROM mk")


def _new_markers(mk: DataFrame) -> DataFrame:
    """Half of them fall on frames that are taken."""
    return mk.where("duration = 1").withColumn("frame_id", F.when(F.col("frame_id") % 4 < 2, F.col("frame_id")).otherwise(F.col("frame_id") + 0.5)).withColumn("color", F.lit("ORANGE"))


_marker_query(
    "marker_add",
    lambda mk: m.added(mk, _new_markers(mk))[0].select("frame_id", "color", "note"),
    "SELECT frame_id, color, note FROM mk UNION ALL SELECT frame_id + 0.5, 'Orange', note FROM mk WHERE NOT frame_id % 4 < 2",
)


@_query(o.px("SELECT frame_number, y, x, b, g, r FROM px WHERE y < 4 AND x >= 3"))
def roi_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slatecast.params import Params

    return pixels.region(views.pixels(spark, sf_dir), 8, 8, Params(roi_height=0.5)).drop("video_id")


@_query(o.px("SELECT frame_number, y, x, h, l, s FROM hls"))
def hls_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.with_hls(views.pixels(spark, sf_dir)).select("frame_number", "y", "x", "h", "l", "s")


@_query(o.px("SELECT frame_number, count(*) FILTER (green = 1) AS green, count(*) FILTER (orange = 1) AS orange FROM flags GROUP BY frame_number"))
def color_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels.DEFAULT
    rows = pixels.with_hls(views.pixels(spark, sf_dir))
    return rows.groupBy("frame_number").agg(F.count_if(pixels.within(p.vfx_low, p.vfx_high)).alias("green"), F.count_if(pixels.within(p.di_low, p.di_high)).alias("orange"))


@_query(o.morph("g >= 60", "mask_pixels"))
def morph_open_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.opened_counts(views.pixels(spark, sf_dir), {"mask_pixels": F.col("g") >= 60}).drop("video_id")


@_query(o.COLOURED)
def colored_pixel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.coloured_counts(views.pixels(spark, sf_dir)).drop("video_id")


def example_lut(size: int = 3) -> np.ndarray:
    """A small colour table: each channel bent, and a little of the next mixed in."""
    r, g, b = np.meshgrid(*[np.arange(size) / (size - 1)] * 3, indexing="ij")
    return np.stack([0.75 * r * r + 0.25 * g, 0.5 * g + 0.5 * g * g, 0.875 * b + 0.125 * r], axis=-1)


@_query(o.LUT)
def lut_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.lut_enhanced(views.pixels(spark, sf_dir), example_lut()).select("frame_number", "y", "x", "b", "g", "r")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition answers made up from detections: two items, the last of up to three fragments."""
    rows = views.detections(spark, sf_dir)
    poly = F.array(*[F.col(c).cast("double") + 0.6 for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")])
    small = F.array(*[F.lit(float(v)) for v in (1, 2, 9, 2, 9, 4, 1, 4)])

    def item(texts: list[Column], scores: list[Column], polys: list[Column]) -> Column:
        return F.struct(F.array(*texts).alias("rec_texts"), F.array(*scores).alias("rec_scores"), F.array(*polys).alias("rec_polys")).cast(ocr.ITEM)

    blank = F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 4 == 1, "  ").otherwise("　tail ")
    last = item([F.when(F.col("k") % 9 == 0, "").otherwise(F.concat(F.lit(" "), "text")), blank, F.lit("extra")], [F.col("confidence"), F.lit(0.5)], [poly, small])
    return rows.select("rid", F.array(item([F.lit("first")], [F.lit(0.9)], [small]), last).alias("items"))


@_query(o.FRAGMENTS)
def ocr_fragment_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.assembled(_payloads(spark, sf_dir)).select("rid", "text", F.round("confidence", 9).alias("confidence"), F.size("fragments").alias("n"))


@_query(o.POLYGONS)
def poly_to_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(spark, sf_dir).select("rid", F.explode(F.element_at("items", 2)["rec_polys"]).alias("p"))
    return rows.select("rid", geometry.box_of(F.col("p")).alias("b")).select("rid", "b.*")


@_query(o.LARGEST)
def representative_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.assembled(_payloads(spark, sf_dir)).select("rid", "bbox.*")


@_query(o.MOCK)
def ocr_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _det(spark, sf_dir).select("rid", "frame_number", "text_type", F.lit(b"").alias("image_bytes"))
    read = ocr.assembled(ocr.recognized(frames))
    return read.select("rid", "frame_number", "text", "confidence", "bbox.x1", "bbox.y2")


@_query(o.LEGACY_TRIGGER)
def legacy_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = d.over_threshold(views.detections(spark, sf_dir)).withColumn("readable", F.col("k") % 5 != 0)
    return trigger.triggered(hits, readable="readable").select("rid", "frame_number", "text_type", "pixel_count")


@_query(o.FRAME_IDS)
def frame_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a video's frames, without opening one."""
    return frame_numbers(spark, 100, spark.read.parquet(f"{sf_dir}/embeddings.parquet").count())


def _corner(data: str = "data") -> list[Column]:
    """The first and the last pixel of a frame."""
    return [F.hex(F.substring(data, 1, 3)).alias("first_pixel"), F.hex(F.substring(data, 32 * 32 * 3 - 2, 3)).alias("last_pixel")]


@_query(o.FRAME_SOURCE)
def frame_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw video made from embeddings, of which the data source reads the ranges that the condition leaves."""
    path, options = views.raw_video(spark, sf_dir)
    frames = read_frames(spark, path, **options).where("frame_number BETWEEN 130 AND 420")
    return frames.select("video_id", "frame_number", "height", "width", F.length("data").alias("n_bytes"), *_corner())


@_query(o.FRAMES_WANTED)
def frames_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that events name, some of which the video does not have."""
    path, options = views.raw_video(spark, sf_dir)
    wanted = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("rid"), (F.col("event_id") * 7 % 600).alias("frame_number"))
    return frames_at(wanted, path, block=64, **options).select("rid", "frame_number", *_corner())


#: For frames of 32 by 32: the whole frame is the region, and two cells make a hit.
_GRIDS = Params(roi_height=1.0, roi_left=0.0, min_pixels=31, min_rows=2)


@_query(o.VIDEO_PIPELINE)
def video_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the frames of a file to the result table: counts, sampling, recognition by the engine for tests, post-processing."""
    path, options = views.raw_video(spark, sf_dir)
    return postprocess(detect(spark, path, params=_GRIDS, **options), _GRIDS).select(*_ROW, "timecode", "leader")


@_query(o.VIDEO_PIPELINE_LEGACY)
def video_pipeline_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the frames of a file to results the older way: whole regions, the older trigger, all items of an answer."""
    path, options = views.raw_video(spark, sf_dir)
    return detect_legacy(spark, path, params=_GRIDS, **options).select("frame_number", "timecode", "text", "pixel_count", "confidence", "text_type")


def example_lut_one(size: int = 5) -> np.ndarray:
    """A small table of one dimension: red squared, green halved, blue as it is."""
    value = np.arange(size) / (size - 1)
    return np.stack([value * value, value * 0.5, value], axis=-1)


@_query(o.LUT_ONE)
def lut_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.lut_enhanced(views.pixels(spark, sf_dir), example_lut_one()).select("frame_number", "y", "x", "b", "g", "r")

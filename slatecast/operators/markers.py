"""Timeline markers: a table keyed by timeline and frame, with the usual ways to read, change and sum it up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "frame_id double, color string, name string, note string, duration double, custom_data string"
FIELDS = ("frame_id", "color", "name", "note", "duration", "custom_data")
#: Colours by their lower-case names. Other names, VFX and DI among them, stay as they are.
COLOURS = ("Green", "Orange", "Red", "Blue", "Cyan", "Magenta", "Yellow")


def colour(name: Column) -> Column:
    found = F.create_map(*[F.lit(x) for c in COLOURS for x in (c.lower(), c)])
    return F.coalesce(F.try_element_at(found, F.lower(name)), name)


def stored(raw: DataFrame, arrival: str | None = None) -> DataFrame:
    """Markers as read from a store: missing strings are empty, missing durations 1; of markers at one frame the last stays."""
    columns = [F.col("timeline_id"), F.col("frame_id").cast("double").alias("frame_id"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("color", "name", "note")], F.coalesce(F.col("duration").cast("double"), F.lit(1.0)).alias("duration"), F.coalesce("custom_data", F.lit("")).alias("custom_data")]
    rows = raw.select(*columns, *([F.col(arrival).alias("_at")] if arrival else [F.lit(0).alias("_at")]))
    last = F.row_number().over(Window.partitionBy("timeline_id", "frame_id").orderBy(F.col("_at").desc(), *[F.col(c).desc() for c in FIELDS[1:]]))
    return rows.withColumn("_rank", last).where("_rank = 1").drop("_rank", "_at")


def in_order(markers: DataFrame) -> DataFrame:
    return markers.orderBy("timeline_id", "frame_id")


def last_ones(markers: DataFrame, n: int = 5) -> DataFrame:
    return markers.orderBy(F.col("frame_id").desc(), "timeline_id").limit(n).orderBy("frame_id", "timeline_id")


def by_colour(markers: DataFrame, name: str) -> DataFrame:
    return markers.where(F.col("color") == name)


def at_frame(markers: DataFrame, frame: float) -> DataFrame:
    return markers.where(F.col("frame_id") == float(frame))


def by_custom_data(markers: DataFrame, value: str) -> DataFrame:
    return markers.where(F.col("custom_data") == value)


def in_range(markers: DataFrame, start: float, end: float) -> DataFrame:
    return markers.where(F.col("frame_id").between(float(start), float(end)))


def without_frame(markers: DataFrame, frame: float) -> DataFrame:
    return markers.where(F.col("frame_id") != float(frame))


def without_range(markers: DataFrame, start: float, end: float) -> DataFrame:
    return markers.where(~F.col("frame_id").between(float(start), float(end)))


def cleared(markers: DataFrame, start: float, end: float) -> DataFrame:
    """How many markers a clearing of the range finds and deletes."""
    n = F.count_if(F.col("frame_id").between(float(start), float(end)))
    return markers.agg(n.alias("deleted"), n.alias("total_found"))


def without_first_custom_data(markers: DataFrame, value: str) -> DataFrame:
    """Less the first marker, by frame, that bears the value; one of each timeline."""
    first = by_custom_data(markers, value).groupBy("timeline_id").agg(F.min("frame_id").alias("frame_id"))
    return markers.join(first, ["timeline_id", "frame_id"], "left_anti")


def without_colour(markers: DataFrame, name: str) -> DataFrame:
    """Less a colour, by its usual name in any case; ``All`` leaves none."""
    return markers.limit(0) if name == "All" else markers.where(F.col("color") != colour(F.lit(name)))


def without_any(markers: DataFrame) -> DataFrame:
    return without_colour(markers, "All")


def added(markers: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The markers with new ones, and the new ones that were refused, as their frame was taken."""
    key = ["timeline_id", "frame_id"]
    new = new.withColumn("color", colour(F.col("color")))
    ranked = new.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("color", "name", "note")))
    free = ranked.where("_rank = 1").drop("_rank").join(markers.select(*key), key, "left_anti")
    refused = ranked.where("_rank > 1").drop("_rank").unionByName(ranked.where("_rank = 1").drop("_rank").join(markers.select(*key), key, "left_semi"))
    return markers.unionByName(free.select(markers.columns)), refused


def colour_counts(markers: DataFrame) -> DataFrame:
    return markers.groupBy("color").agg(F.count(F.lit(1)).alias("n"))


def summary(markers: DataFrame) -> DataFrame:
    """One row: how many, how many of each colour, the range of frames and the first marker (both null if none).

    The markers it sums up, in order, are ``in_order``; the file of both is written by ``sources.files.write_marker_json``.
    """
    colours = colour_counts(markers).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("color", "n")))).alias("colors"))  # a row a colour
    some = F.count(F.lit(1)) > 0
    rows = markers.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.when(some, F.struct(F.min("frame_id").alias("min"), F.max("frame_id").alias("max"))).alias("frame_range"),
        F.min_by(F.struct(*FIELDS), F.struct(*FIELDS)).alias("first"),
    )
    return rows.join(F.broadcast(colours)).select("total_count", "colors", "frame_range", "first")


def described(markers: DataFrame) -> DataFrame:
    """Each marker and a line of text that tells of it."""
    line = F.concat(F.lit("Marker(frame="), F.col("frame_id").cast("string"), F.lit(", color="), "color", F.lit(", name='"), "name", F.lit("')"))
    return markers.withColumn("line", line)


def from_type(kind: Column) -> tuple[Column, Column]:
    """Colour and name of the marker that a detection of this type becomes."""
    return F.when(kind == "VFX", "Green").when(kind == "DI", "Yellow").otherwise("Blue"), F.when(kind.isin("VFX", "DI"), kind).otherwise(kind)


#: What a float may look like: what the engine's cast takes less its suffixes, plus nothing.
_NUMBER = r"(?i)^[\s]*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)[\s]*$"


def from_rows(rows: DataFrame, frame: str = "frame", note: str = "note", kind: str = "kind", timeline: str = "t0") -> DataFrame:
    """Markers from rows of text, with ``ok``: whether the frame could be read. Texts lose white space at their ends."""
    from slatecast.functions.text import strip

    at = F.when(F.col(frame).rlike(_NUMBER), F.expr(f"try_cast(trim(`{frame}`) as double)"))
    of = strip(F.coalesce(F.col(kind), F.lit("")))
    colours, names = from_type(of)
    return rows.select(F.lit(timeline).alias("timeline_id"), at.alias("frame_id"), colours.alias("color"), names.alias("name"), strip(F.coalesce(F.col(note), F.lit(""))).alias("note"), F.lit(1.0).alias("duration"), F.lit("").alias("custom_data"), at.isNotNull().alias("ok"))


def import_stats(imported: DataFrame) -> DataFrame:
    return imported.agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.count(F.lit(1)).alias("total"))

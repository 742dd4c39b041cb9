"""Filters, sampling and statistics of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatecast.functions.text import normalized, strip
from slatecast.params import DEFAULT, Params


def over_threshold(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Hits: rows with more coloured pixels than the threshold."""
    return rows.where(F.col("pixel_count") > params.min_pixels)


def confident(rows: DataFrame, minimum: float = DEFAULT.min_confidence, legacy: bool = False) -> DataFrame:
    """Rows whose confidence is not under the minimum (NaN is not), texts repaired, blank ones dropped."""
    # a repaired text has its prefix unless there was no text at all, so the blank ones are known before the repair
    kept = rows.where(~(F.col("confidence") < minimum) & (F.col("text") != ""))
    return kept.withColumn("text", normalized(F.col("text"), F.col("text_type"), legacy))


#: Frames of a block, which is sampled in one task.
BLOCK = 4096


def _block(block: int) -> Column:
    return F.floor(F.col("frame_number") / block)


def _before(column: Column, *key: str) -> Column:
    """The sum over the blocks before, of a table with a row a block."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def every_other(hits: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of each video and type the first hit, the third, and so on.

    Hits are numbered within blocks of frames, from whether the blocks before have an odd number of them.
    """
    key = ["video_id", "text_type"]
    dealt = hits.withColumn("_block", _block(block))
    odd = dealt.groupBy(*key, "_block").agg(F.count(F.lit(1)).alias("_n")).select(*key, "_block", (_before(F.col("_n"), *key) % 2).alias("_odd"))
    nth = F.row_number().over(Window.partitionBy(*key, "_block").orderBy("frame_number", "rid"))
    return dealt.withColumn("_nth", nth).join(odd, [*key, "_block"]).where("(_nth + _odd) % 2 = 1").select(*hits.columns)


def one_colour(hits: DataFrame, block: int = BLOCK) -> DataFrame:
    """At most one hit a frame: every other VFX frame, and every other DI frame of those that VFX did not give.

    What the sampler carries from frame to frame is two parities: of VFX frames, and of the DI frames tried. A block of
    frames maps these to others: it adds its VFX frames to the first and, for either value of the first, the DI frames it
    would try to the second. So blocks are worked on apart for both values of the first, their maps, a row a block, are
    composed in order, and each block then takes what holds for it.
    """
    frame = Window.partitionBy("video_id", "_block", "frame_number")
    so_far = Window.partitionBy("video_id", "_block").orderBy("frame_number")  # rows of one frame count together
    rows = hits.withColumn("_block", _block(block)).withColumns({
        "_first": (F.row_number().over(frame.orderBy("text_type", "rid")) == 1).cast("int"),
        "_vfx": F.max((F.col("text_type") == "VFX").cast("int")).over(frame),
        "_di": F.max((F.col("text_type") == "DI").cast("int")).over(frame),
    }).withColumn("_n", F.sum(F.col("_vfx") * F.col("_first")).over(so_far))
    for p in (0, 1):
        given = F.when((F.col("_vfx") == 1) & ((F.col("_n") + p) % 2 == 1), 1).otherwise(0)
        rows = rows.withColumn(f"_given{p}", given).withColumn(f"_try{p}", F.when(F.col(f"_given{p}") == 0, F.col("_di")).otherwise(0))
    rows = rows.withColumns({f"_tries{p}": F.sum(F.col(f"_try{p}") * F.col("_first")).over(so_far) for p in (0, 1)})
    key = ["video_id", "_block"]
    maps = rows.groupBy(*key).agg(F.max("_n").alias("_adds"), *[F.max(f"_tries{p}").alias(f"_adds{p}") for p in (0, 1)])
    states = maps.withColumn("_p", _before(F.col("_adds"), "video_id") % 2)
    states = states.select(*key, "_p", (_before(F.when(F.col("_p") == 0, F.col("_adds0")).otherwise(F.col("_adds1")), "video_id") % 2).alias("_q"))
    held = rows.join(states, key)
    given, tried, tries = (F.when(F.col("_p") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in ("_given", "_try", "_tries"))
    chosen = F.when(F.col("text_type") == "VFX", given == 1).when(F.col("text_type") == "DI", (tried == 1) & ((tries + F.col("_q")) % 2 == 1)).otherwise(False)
    return held.where(chosen).select(*hits.columns)


def moving_mean(hits: DataFrame, rows: int = 5) -> DataFrame:
    """``mean_pixels`` over the last rows of the same video and type, the present one included."""
    window = Window.partitionBy("video_id", "text_type").orderBy("frame_number", "rid").rowsBetween(1 - rows, 0)
    return hits.withColumn("mean_pixels", F.avg("pixel_count").over(window))


def statistics(rows: DataFrame) -> DataFrame:
    """One row: how many detections, of each type, their mean confidence (0 if none) and range of frames."""
    low, high = F.min("frame_number"), F.max("frame_number")
    return rows.agg(
        F.count(F.lit(1)).alias("total_results"),
        F.count_if(F.col("text_type") == "VFX").alias("vfx_count"),
        F.count_if(F.col("text_type") == "DI").alias("di_count"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.when(low.isNull(), "N/A").otherwise(F.concat_ws(" - ", low, high)).alias("frame_range"),
    )


def best_in_band(rows: DataFrame, group: list[str], band: float = DEFAULT.band) -> DataFrame:
    """Of each group the row with the longest stripped text among those nearly as confident as the best; then the earliest."""
    over = Window.partitionBy(*group)
    near = rows.withColumn("_top", F.max("confidence").over(over)).where(F.abs(F.col("confidence") - F.col("_top")) < band)
    return _first(near, group, [F.length(strip(F.col("text"))).desc(), F.col("frame_number"), F.col("rid")]).drop("_top")


def best_exact(rows: DataFrame, group: list[str]) -> DataFrame:
    """Of each group the most confident row; of equals that with most pixels, then the earliest."""
    return _first(rows, group, [F.col("confidence").desc(), F.col("pixel_count").desc(), F.col("rid")])


def _first(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_rank = 1").drop("_rank")

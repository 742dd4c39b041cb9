"""Dealing rows to tasks by key, for functions that need all rows of a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, *keys: str | Column, parts: int | None = None) -> DataFrame:
    """``rows`` in partitions that each hold whole keys, for ``mapInArrow``, which cannot say that it needs that.

    ``repartition`` by the columns that a join or grouping before it was by is left out by Spark, as the rows lie so already;
    the join may still turn into a broadcast when its sides turn out small, and then rows stay where they were
    read. A hash of the keys is no such column, so this exchange stands whatever comes before.
    """
    place = F.xxhash64(*keys)
    return rows.repartition(place) if parts is None else rows.repartition(parts, place)

"""Bounded samples of labelled documents, from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatecast.llm.common import held_out, utf8

#: Rows with this remainder of crc32(doc_id) are held out and never learned from.
FOLDS, TEST_FOLD = 5, 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """``(text, label)`` of at most ``sample`` labelled documents outside the test fold, the same ones every time.

    The ids are chosen by hash, so the sample is even; null labels and ids are passed over, and where an id has
    several labels or texts all of them count. The chosen labels have a proven bound, so they may be broadcast.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).where("_id is not null and label is not null").where(~held_out("_id", FOLDS, TEST_FOLD))
    chosen = ids.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample)
    return docs.select(F.col("doc_id").cast("long").alias("_id"), utf8()).join(F.broadcast(chosen), "_id").select("_id", "text", "label")

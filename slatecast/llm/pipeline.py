"""The corpus pipeline: stages that each take a table of documents and give the next one.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slatecast.llm import mixing, packing, simhash, suffixes, toxicity
from slatecast.llm.common import read, remove, shared_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the toxic ones; the machine learns from the labels beside the tables.

    Null and empty texts have the score of no words, repeated rows are judged alike, and an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles alike to 0.8 or more), that of the least id; all others stay.

    Null and empty texts are copies of each other, rows that repeat are one group, null ids come last in it, and an
    empty table stays empty.
    """
    return simhash.one_of_copies(docs)


#: Bytes of a repeated string that is taken out, so that passages of fifty short words are caught, and of the grams it is found by.
REPEAT_BYTES, GRAM_BYTES = 256, 128


def suffixes_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that stand elsewhere, too; one of which nothing is left goes.

    All places of a repeated string go, as the operator has it. Texts with nothing to take out stay as they are, null
    and empty ones too; rows that repeat are repeats of each other; an empty table stays empty.
    """
    return suffixes.without_repeats(docs, REPEAT_BYTES, GRAM_BYTES)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights: a row for each stretch of a document that is taken.

    Texts without words (null ones too) have nothing to take; a null source is the last one; rows that repeat are each
    taken from; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their ids.

    A null or empty text is its end alone, rows that repeat are each packed, and an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("suffixes", suffixes_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express a learned classifier or tokens; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two of them is written to the shared checkpoint folder, and
    removed when the stage after has been written."""
    docs, folder, last = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    return docs

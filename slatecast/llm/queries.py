"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatecast.llm import language, media, merkle, minhash, mixing, packing, periodic, pipeline, quality, simhash, spotsigs, suffixes, toxicity, urls
from slatecast.llm.common import read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.judge(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.texts_as_media(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: ``kept_text``, what ``kept_sha256`` is of as a text, and ``text``, the text less repeated
    passages of over fifty words, which may be shorter than the contract's strings."""
    done = suffixes.remove_repeats(read(spark, sf_dir, "documents"), gram=suffixes.PASSAGE_GRAM, passage=suffixes.PASSAGE)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("rest").alias("text"), F.col("text").alias("kept_text"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    proved = merkle.manifest(read(spark, sf_dir, "documents"), changed=merkle.tampered())
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summarised(periodic.periodic_runs(read(spark, sf_dir, "documents"), change=periodic.planted))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def spotsigs_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside op10: each document's class of equal fingerprints and with how many other classes it is near."""
    return spotsigs.links(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_quality": op1_quality, "op2_mixing": op2_mixing, "op3_toxicity": op3_toxicity, "op4_urls": op4_urls, "op5_packing": op5_packing, "op6_language": op6_language, "op7_simhash": op7_simhash, "op8_webp": op8_webp, "op9_suffixes": op9_suffixes, "op10_spotsigs": op10_spotsigs, "op11_merkle": op11_merkle, "op12_periodic": op12_periodic, "op13_minhash": op13_minhash, "pipeline": pipeline.run, "spotsigs_links": spotsigs_links}
ORACLES: dict[str, str] = {"op4_urls": urls.ORACLE, "op11_merkle": merkle.ORACLE, "op13_minhash": minhash.ORACLE} | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})

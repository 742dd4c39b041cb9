"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; where it is unset, a local one, but only for a local master."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, so that lost executors cost no recomputation.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes what is no longer referred to.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def utf8(column: str = "text") -> Column:
    """The bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def words(raw: bytes) -> list[bytes]:
    """The words of a UTF-8 text with A-Z lower-cased; ``bytes`` methods know ASCII only, as wanted."""
    return raw.lower().split()


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


#: Rows of a batch that are turned into Python objects at a time.
SLICE_ROWS = 512


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows, so that what is made of them takes little memory."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(at, SLICE_ROWS)


def by_slices(f: Callable[..., list], kind: pa.DataType, *arrays: pa.Array) -> pa.Array:
    """``f`` of lists of values, a few rows at a time, as one array."""
    parts = [pa.array(f(*(a.slice(at, SLICE_ROWS).to_pylist() for a in arrays)), kind) for at in range(0, len(arrays[0]), SLICE_ROWS)]
    release()
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """``mapInArrow`` where ``make()`` builds, once a task, the function that turns one batch into another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                if (out := step(part)) is not None:
                    yield out
        del step
        release()

    return df.mapInArrow(run, schema)


def held_out(column: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the decimal id leaves ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == rest


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs laid end to end: where each begins, and the run that each element belongs to."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    return starts, np.repeat(np.arange(len(lengths)), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

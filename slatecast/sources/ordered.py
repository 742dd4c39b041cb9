"""One ordered file written by many tasks: a Python data sink, ``format("ordered_parts")``, and the joining of its parts.

Sorted rows lie in ranges, one a partition. Each task writes its range into a part of its own, under another name until
it is whole; the driver gets no row, only each part's length. Sums of the lengths before it are where a part begins in
the file, and so the parts are copied to their places by as many tasks. The file gets its name when it is complete, so
no reader sees a part of it, whatever task is killed or repeated.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: The list of parts that a commit leaves, and bytes copied at a time.
LISTING, CHUNK = "parts.json", 8 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    size: int


class PartWriter(DataSourceArrowWriter):
    """The values of the one column, ``value``, of a partition, with a separator between them, as one part."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.separator = options["path"], bytes.fromhex(options.get("separator", ""))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        name = f"{number:08d}-{uuid.uuid4().hex}"
        os.makedirs(self.folder, exist_ok=True)
        path, size = os.path.join(self.folder, name), 0
        with open(f"{path}.half", "wb") as file:
            for batch in iterator:
                for value in batch.column(0).to_pylist():
                    value = value.encode() if isinstance(value, str) else value or b""
                    size += file.write(self.separator + value if size else value)
        os.replace(f"{path}.half", path)
        return Part(number, name, size)

    def commit(self, messages: list[Part | None]) -> None:
        """Lists the parts of the attempts that count, in order; those of others are never read."""
        os.makedirs(self.folder, exist_ok=True)
        parts = sorted((m.number, m.name, m.size) for m in messages if m is not None)
        half = os.path.join(self.folder, f"{LISTING}.half")
        with open(half, "w", encoding="utf-8") as file:
            json.dump(parts, file)
        os.replace(half, os.path.join(self.folder, LISTING))

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class OrderedParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_parts"

    def schema(self) -> str:
        return "value binary"

    def writer(self, schema: object, overwrite: bool) -> PartWriter:
        return PartWriter(dict(self.options))


def places(sizes: list[int], head: int, separator: int) -> tuple[list[int], int]:
    """Where each of some parts begins behind a head, a separator standing between those that are not empty; and the end of the last."""
    full = [s for s in sizes if s]
    starts = iter(accumulate((s + separator for s in full), initial=head))
    at = [next(starts) if s else head for s in sizes]
    return at, head + sum(full) + separator * max(len(full) - 1, 0)


def write_ordered(rows: DataFrame, path: str, head: bytes = b"", tail: bytes = b"", separator: bytes = b"") -> str:
    """``head``, the values of ``rows(value)`` in their order with ``separator`` between them, and ``tail``, as the file ``path``.

    ``path`` lies where the driver and all executors reach it. Values are texts or bytes; null is empty, and
    where there is a separator, values should not be. If the job fails,
    what stood at ``path`` stands there still.
    """
    spark, named = rows.sparkSession, path
    path = os.path.abspath(path)  # executors run in folders of their own
    spark.dataSource.register(OrderedParts)
    folder, whole = f"{path}.parts-{uuid.uuid4().hex}", f"{path}.whole-{uuid.uuid4().hex}"
    try:
        rows.select("value").write.format("ordered_parts").option("path", folder).option("separator", separator.hex()).mode("append").save()
        with open(os.path.join(folder, LISTING), encoding="utf-8") as file:
            parts = json.load(file)
        starts, end = places([size for _, _, size in parts], len(head), len(separator))
        with open(whole, "wb") as file:
            file.write(head)
            file.seek(end)
            file.write(tail)
            file.truncate(end + len(tail))
        wanted = [(os.path.join(folder, name), at, at > len(head)) for (_, name, size), at in zip(parts, starts, strict=True) if size]
        if wanted:
            copied = spark.createDataFrame(wanted, "part string, at long, later boolean").repartition(len(wanted), "part")
            done = copied.mapInArrow(_copier(whole, separator), "size long").agg(F.sum("size")).first()[0]
            if done != end - len(head):
                raise OSError(f"{done} bytes of {end - len(head)} were copied to {path}")
        os.replace(whole, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        if os.path.exists(whole):
            os.remove(whole)
    return named


def _copier(whole: str, separator: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for part, at, later in zip(*(batch[c].to_pylist() for c in ("part", "at", "later")), strict=True):
                lead = separator if later else b""
                with open(part, "rb") as source, open(whole, "r+b") as target:
                    target.seek(at - len(lead))
                    size = target.write(lead)
                    while data := source.read(CHUNK):
                        size += target.write(data)
                sizes.append(size)
            yield pa.record_batch([pa.array(sizes, pa.int64())], ["size"])

    return run

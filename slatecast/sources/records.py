"""Records of a text file that may hold the mark they end by, read by many tasks.

Spark's text source cuts a file at every such mark, a block of bytes a task. Whether a block begins within quotes depends on all
before it, so each is first summed up for either case; the summaries, one a block, are put together in order on the
driver, and then the blocks are read again, each from the state in which it begins. A record that reaches over the end of a
block is put together from its parts.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records that go on at a time.
ROWS = 4096
BOM = b"\xef\xbb\xbf"


class Format(Protocol):
    """How a file is cut. A piece is what stands between two marks."""

    MARK: str
    GLUE: str  # what stands between the parts of a record

    def summed(self, pieces: Iterable[bytes], first: bool) -> Any:
        """What a block does to the state in which it begins; ``first`` if it is its file's first."""

    def starts(self, blocks: list[tuple[int, Any]], size: int) -> dict[int, Any] | None:
        """The state in which each block of a file of ``size`` bytes begins, or none if the file cannot be read in blocks."""

    def open_from(self, state: Any) -> int | None:
        """The block where the record began that is open in ``state``."""

    def records(self, pieces: Iterable[bytes], block: int, state: Any) -> Iterator[tuple[int | None, bytes]]:
        """Whole records with none, and parts of others with the block where they began."""

    def finished(self, record: bytes) -> bytes:
        """A whole record as it goes on."""


@contextmanager
def same_blocks(spark: SparkSession) -> Iterator[None]:
    """While this lasts Spark cuts a file into the same blocks each time, also if executors come or go."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def read_records(spark: SparkSession, path: str, form: Format) -> DataFrame | None:
    """The records of all files of ``path``, in no order, as ``value``; none if one of the files cannot be read in blocks.

    They must be used up within ``same_blocks``, as this is called.
    """
    meta = F.col("_metadata")
    named = [F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size")]
    pieces = spark.read.option("lineSep", form.MARK).text(path).select(*named, F.col("value").cast("binary").alias("value"))
    files: dict[int, tuple[int, list]] = {}
    for file, block, size, summary in pieces.mapInArrow(_summing(form), "file long, block long, size long, summary binary").collect():  # a row a block
        files.setdefault(file, (size, []))[1].append((block, pickle.loads(summary)))  # noqa: S301
    states: dict[tuple[int, int], Any] = {}
    for file, (size, blocks) in files.items():
        begun = form.starts(sorted(blocks, key=lambda b: b[0]), size)
        if begun is None:
            return None
        states |= {(file, block): state for block, state in begun.items()}
    schema = "file long, begun long, at long, value string"
    whole = pieces.mapInArrow(_reading(form, states, False), schema).select("value")
    if all(form.open_from(s) is None for s in states.values()):
        return whole
    parts = pieces.mapInArrow(_reading(form, states, True), schema).groupBy("file", "begun").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([form.finished(x.encode()).decode() for x in batch["value"].to_pylist()], pa.string())], ["value"])

    return whole.unionByName(parts.select(F.array_join(F.col("parts")["value"], form.GLUE).alias("value")).mapInArrow(finish, "value string"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], Iterator[bytes]]]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, some in groupby(rows, lambda row: row[:3]):
        yield key, (row[3] for row in some)


def _summing(form: Format):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block, size), values in _blocks(batches):
            yield pa.record_batch([[file], [block], [size], [pickle.dumps(form.summed(values, block == 0))]], ["file", "block", "size", "summary"])

    return run


def _reading(form: Format, states: dict[tuple[int, int], Any], parts: bool):
    """Whole records, or the parts of those that are not."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        file, begun, at, value = zip(*rows, strict=True)
        numbers = [pa.array(x, pa.int64()) for x in (file, begun, at)]
        return pa.record_batch([*numbers, pa.array([v.decode("utf-8", "replace") for v in value], pa.string())], ["file", "begun", "at", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for (file, block, _), values in _blocks(batches):
            for begun, value in form.records(values, block, states[file, block]):
                if (begun is not None) == parts:
                    held.append((file, begun, block, value if parts else form.finished(value)))
                    if len(held) == ROWS:
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)

    return run


@dataclass
class Lines:
    """Where a block of a CSV file begins: ``begun`` names the block of the open record, ``titles`` says that the header is still to come."""

    begun: int | None
    titles: bool
    skip: bool = False  # the open record is the header
    end: bytes = b""  # what stands before LF at line ends


class Csv:
    """Records of a CSV file: quotes open at the start of a field only, two of them stand for one, and behind closing ones stands a comma or a line end.

    Files in which something else stands there, quotes that stay open or lines that end by single CRs are not read in blocks.
    """

    MARK = GLUE = "\n"

    def __init__(self, header: bool) -> None:
        self.header = header

    @staticmethod
    def _inside(line: bytes, inside: bool) -> tuple[bool, bool]:
        """Whether quotes are open behind a line, as they are or are not before it, and whether something stands behind closed ones."""
        at, bad = 0, False
        if b'"' not in line:
            return inside, bad
        while True:
            if inside or line[at : at + 1] == b'"':
                at += not inside
                while (at := line.find(b'"', at)) >= 0 and line[at + 1 : at + 2] == b'"':
                    at += 2
                if at < 0:
                    return True, bad
                inside, at = False, at + 1
                bad = bad or line[at : at + 1] not in b",\r" or (line[at : at + 1] == b"\r" and at + 1 < len(line))
            if (at := line.find(b",", at)) < 0:
                return False, bad
            at += 1

    def summed(self, pieces: Iterable[bytes], first: bool) -> tuple:
        """For both cases whether quotes are open in the end, how many records begin, two at most, and whether there is what is not read so; and a line end."""
        ends, begun, wrong, end = [False, True], [0, 0], [False, False], None
        for line in pieces:
            if end is None:
                wrong = [first and 0 <= line.find(b"\r") < len(line) - 1] * 2
                end = b"\r" if line.endswith(b"\r") else b""
                line = line.removeprefix(BOM) if first else line
            for k in (0, 1):
                begun[k] += begun[k] < 2 and not ends[k] and line not in (b"", b"\r")
                ends[k], bad = self._inside(line, ends[k])
                wrong[k] = wrong[k] or bad
        return ends, begun, wrong, end

    def starts(self, blocks: list[tuple[int, tuple]], size: int) -> dict[int, Lines] | None:
        first = blocks[0][1][3] if blocks else b""
        states, state = {}, Lines(None, self.header, end=first)
        for block, (ends, begun, wrong, _) in blocks:
            states[block] = state
            inside = state.begun is not None
            if wrong[inside]:
                return None
            end, n = ends[inside], begun[inside]
            still = end and inside and not n
            header_open = end and (state.skip if still else state.titles and n == 1)
            state = Lines((state.begun if still else block) if end else None, state.titles and not n, header_open, first)
        return states if state.begun is None else None

    def open_from(self, state: Lines) -> int | None:
        return state.begun

    def records(self, pieces: Iterable[bytes], block: int, state: Lines) -> Iterator[tuple[int | None, bytes]]:
        begun, skip, titles, blank, lines = state.begun, state.skip, state.titles, {b"", state.end}, []
        for k, line in enumerate(pieces):
            if k == block == 0:
                line = line.removeprefix(BOM)
            inside = begun is not None or bool(lines)
            if not inside:
                if line in blank:
                    continue
                skip, titles = titles, False
            inside, _ = self._inside(line, inside)
            lines.append(line)
            if not inside:
                if not skip:
                    yield begun, self._text(lines, state.end)
                begun, lines = None, []
        if lines and not skip:
            yield block if begun is None else begun, self._text(lines, state.end)

    @staticmethod
    def _text(lines: list[bytes], end: bytes) -> bytes:
        """With LF for CRLF, in quotes, too, if that is how the file's lines end; as Spark reads it."""
        return b"\n".join(line.removesuffix(end) for line in lines)

    def finished(self, record: bytes) -> bytes:
        return record


#: A string or what is left of it, or a bracket; and a piece that is an object of plain values alone.
_TOKEN = re.compile(rb'"(?>[^"\\]+|\\.)*+("?)|[{}\[\]]', re.DOTALL)
_REST = re.compile(rb'(?>[^"\\]+|\\.)*+("?)', re.DOTALL)
_PLAIN = re.compile(rb'[\s,]*+(\{(?>[^{}\[\]"]+|"(?>[^"\\]+|\\.)*+")*+)', re.DOTALL)


@dataclass
class Level:
    """Where a block of a JSON file begins: within a string or not, how deep, whether in the array that is wanted, and the block of an open object."""

    inside: bool = False
    depth: int = 0
    wanted: bool = False
    begun: int | None = None


@dataclass
class Walk:
    """What a block does to levels, which are told from where it begins."""

    inside: bool
    level: int = 0
    closed: dict[int, int] = field(default_factory=dict)  # how often each level was come back to
    opened: dict[int, bool] = field(default_factory=dict)  # whether what was opened last to a level is an array of the wanted name

    def tokens(self, piece: bytes, name: bytes) -> Iterator[tuple[bytes, int]]:
        """Goes over a piece; gives its brackets outside strings and where they stand, each when it has been counted."""
        at = 0
        if self.inside:
            found = _REST.match(piece)
            if not found[1]:
                return
            self.inside, at = False, found.end()
        text = (b"", 0)
        for found in _TOKEN.finditer(piece, at):
            token = found[0]
            if token[:1] == b'"':
                text = (token, found.end())
                if not found[1]:
                    self.inside = True
                    return
                continue
            if token in b"{[":
                self.level += 1
                self.opened[self.level] = token == b"[" and text[0] == name and piece[text[1] : found.start()].strip() == b":"
            else:
                self.level -= 1
                self.closed[self.level] = self.closed.get(self.level, 0) + 1
            yield token, found.start()


class JsonArray:
    """The objects of the array ``name`` in the one object that a JSON file is."""

    MARK, GLUE = "}", ""

    def __init__(self, name: str) -> None:
        self.name = b'"%s"' % name.encode()

    def summed(self, pieces: Iterable[bytes], first: bool) -> tuple:
        walks, size, head, piece = [Walk(False), Walk(True)], 0, b"{", b""
        for piece in pieces:
            if first and not size:
                head = piece.removeprefix(BOM).lstrip()[:1]
            size += len(piece) + 1
            for walk in walks:
                if walk.inside or not walk.closed or not _PLAIN.fullmatch(piece):
                    for _ in walk.tokens(piece + b"}", self.name):
                        pass
                else:
                    walk.closed[walk.level] = walk.closed.get(walk.level, 0) + 1
                    walk.opened[walk.level + 1] = False
        return walks, size, head == b"{", not piece.strip()

    def starts(self, blocks: list[tuple[int, tuple]], size: int) -> dict[int, Level] | None:
        states, state, ends, seen = {}, Level(), 0, 0
        for block, (walks, length, object_, blank) in blocks:
            states[block] = state
            walk, seen, last = walks[state.inside], seen + length, blank
            if not object_:
                return None
            ends += walk.closed.get(-state.depth, 0)
            depth = state.depth + walk.level
            wanted = walk.opened.get(2 - state.depth, state.wanted)
            kept = depth > 2 and state.begun is not None and 2 - state.depth not in walk.closed
            state = Level(walk.inside, depth, wanted, state.begun if kept else block if wanted and depth > 2 else None)
        # behind the last mark there may be blanks, which were taken for one more piece that ends by one
        whole = not blocks or (ends == 1 and not state.inside and (seen - size, -state.depth) in {(0, 0)} | ({(1, 1)} if last else set()))
        return states if whole else None

    def open_from(self, state: Level) -> int | None:
        return state.begun

    def records(self, pieces: Iterable[bytes], block: int, state: Level) -> Iterator[tuple[int | None, bytes]]:
        walk, begun, wanted = Walk(state.inside, state.depth), state.begun, state.wanted
        parts: list[bytes] = []
        for piece in pieces:
            if wanted and walk.level == 2 and not walk.inside and (plain := _PLAIN.fullmatch(piece)):
                yield None, plain[1] + b"}"
                continue
            piece, start = piece + b"}", 0 if begun is not None or parts else None
            for token, at in walk.tokens(piece, self.name):
                if token in b"{[" and walk.level == 2:
                    wanted = walk.opened[2]
                elif wanted and token == b"{" and walk.level == 3:
                    start = at
                elif wanted and token == b"}" and walk.level == 2 and start is not None:
                    yield begun, b"".join(parts) + piece[start : at + 1]
                    begun, start, parts = None, None, []
            if start is not None:
                parts.append(piece[start:])
        if parts:
            yield block if begun is None else begun, b"".join(parts)

    def finished(self, record: bytes) -> bytes:
        """With nested values as strings of how they are written, as which Spark reads them from a file, but not from a column."""
        if record.count(b"{") + record.count(b"[") == 1:
            return record
        out, walk, at, start = [], Walk(False), 0, 0
        for token, place in walk.tokens(record, b""):
            if token in b"{[" and walk.level == 2:
                start = place
            elif token in b"}]" and walk.level == 1:
                out += [record[at:start], json.dumps(record[start : place + 1].decode("utf-8", "replace"), ensure_ascii=False).encode()]
                at = place + 1
        return b"".join([*out, record[at:]])

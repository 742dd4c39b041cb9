"""Packing token sequences online by the sum-of-squares rule.

Each task packs the documents of its partition as they come, so nothing is shuffled. Full windows are cut off a long
document; its remainder goes, whole, into the open window of that fill level which keeps the sum of squared counts of partly
filled windows least. The counts are kept in an array by level, GRAIN ids to a level, and a window with less room than a level
is closed as it stands. When the partition ends, and whenever OPEN windows are open, so that a task holds no more however many
documents it has, documents of the emptiest windows are dealt out to fill up the fullest, cut where they must be; the last
window is parted into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatecast.llm.common import release, slices, utf8

WINDOW, END = 1024, 0
#: Windows that a task holds open at most, and ids to a level of a window.
OPEN, GRAIN = 1024, 16
#: So many distinct stretches between blanks are kept tokenized by a worker before it starts anew.
KEPT = 200_000


class Tokenizer:
    """The ids that the ``tokenizers`` library gives by a byte-level BPE file without adding special tokens of its own; a
    special token that the text spells out is one id, as there.

    The pattern never joins over a single blank between two other characters, so texts are cut there and the ids of
    each stretch, which mostly was seen before, are looked up.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = _byte_letters()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.spelled = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.ids, self.used = np.zeros(1 << 20, np.uint16 if self.encoding.max_token_value < 1 << 16 else np.uint32), 0
        self.starts, self.sizes = np.zeros(KEPT, np.int64), np.zeros(KEPT, np.int64)

    def _learn(self, stretches: list[str]) -> None:
        """Tokenize some distinct stretches that are not known."""
        got = list(map(self.encoding.encode_ordinary, stretches))
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        k, n = len(self.known), int(sizes.sum())
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + n, self.ids.dtype)])
        self.ids[self.used : self.used + n] = np.fromiter(chain.from_iterable(got), self.ids.dtype, n)
        self.starts[k : k + len(got)], self.sizes[k : k + len(got)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += n
        self.known.update(zip(stretches, range(k, k + len(got)), strict=True))

    def __call__(self, text: str) -> np.ndarray:
        if not any(name in text for name in self.special):
            return self._plain(text)
        out, at = [], 0
        for found in self.spelled.finditer(text):
            if found.start() > at:
                out.append(self._plain(text[at : found.start()]))
            out.append(np.array([self.special[found[0]]], np.uint32))
            at = found.end()
        return np.concatenate([*out, self._plain(text[at:])] if at < len(text) else out)

    def _plain(self, text: str) -> np.ndarray:
        if "  " in text or text[-1:] == " ":
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        out = []
        pieces = text.split(" ")
        for at in range(0, len(pieces), KEPT // 4):  # a very long text in parts
            some = pieces[at : at + KEPT // 4]
            if len(self.known) + len(some) > KEPT:
                self._forget()
            # the first stretch of a text has no blank before it and is looked up by another name
            some = [" " + p for p in some] if at else [some[0], *[" " + p for p in some[1:]]]
            index = np.fromiter(map(self.known.get, some, repeat(-1)), np.int64, len(some))
            if len(new := np.flatnonzero(index < 0)):
                unknown = [some[k] for k in new]
                self._learn(list(dict.fromkeys(unknown)))
                index[new] = [self.known[p] for p in unknown]
            sizes = self.sizes[index]
            ends = np.cumsum(sizes)
            out.append(self.ids[np.repeat(self.starts[index] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)])
        return np.concatenate(out).astype(np.uint32)


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE files write each byte as a printable letter: itself, or the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Packer:
    """Open windows by ids held. A piece is (document, start, ids, ...); a finished window is a list of pieces.

    ``levels`` counts open windows by fill level, ``counts`` by the exact number of ids, so that one that fits is found.
    """

    def __init__(self, window: int = WINDOW, most: int = OPEN, grain: int = GRAIN) -> None:
        self.window, self.most = window, most
        self.level_of = np.arange(window + 1) // grain
        #: A window that holds so many ids or more is closed.
        self.done = window - grain + 1
        self.levels = np.zeros(int(self.level_of[-1]) + 1, np.int64)
        self.counts = np.zeros(window + 1, np.int64)
        self.held = 0
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]

    def place(self, piece: tuple, size: int) -> list[tuple] | None:
        """Put a piece of less than a window where the sum of squares of ``levels`` grows least; ties go to the fullest."""
        top, level_of, levels = self.window, self.level_of, self.levels
        # taking a window from level g to h changes the sum by 2 (N[h] - N[g] + 1), or less at the ends
        old, new = level_of[: top - size + 1], level_of[size:]
        stays = np.arange(size, top + 1) < self.done
        gain = np.where(stays, 2 * levels[new] + 1, 0)
        gain[1:] = np.where(stays[1:] & (old[1:] == new[1:]), 0, gain[1:] + 1 - 2 * levels[old[1:]])
        gain[1:] = np.where(self.counts[1 : len(gain)] > 0, gain[1:], 4 * self.most + 4)
        at = len(gain) - 1 - int(np.argmin(gain[::-1]))
        pieces = [*(self._take(at) if at else []), piece]
        if at + size >= self.done:
            return pieces
        self._put(at + size, pieces)
        return None

    def _take(self, at: int) -> list[tuple]:
        self.counts[at] -= 1
        self.levels[self.level_of[at]] -= 1
        self.held -= 1
        return self.open[at].pop()

    def _put(self, at: int, pieces: list[tuple]) -> None:
        self.counts[at] += 1
        self.levels[self.level_of[at]] += 1
        self.held += 1
        self.open[at].append(pieces)

    def add(self, piece: tuple) -> Iterator[list[tuple]]:
        """Place a piece of less than a window; if too many windows are open, some are closed first."""
        if self.held >= self.most:
            yield from self.close(self.most // 2)
        if done := self.place(piece, len(piece[2])):
            yield done

    def close(self, keep: int) -> Iterator[list[tuple]]:
        """Close the fullest windows until no more than ``keep`` are left, filled up with documents of the emptiest ones."""
        filler: list[tuple] = []
        size = 0
        while self.held > keep:
            at = int(np.flatnonzero(self.counts)[-1])
            pieces, room = self._take(at), self.window - at
            while size < room and self.held:
                low = int(np.flatnonzero(self.counts)[0])
                filler += self._take(low)
                size += low
            if size < room:
                # the last of all
                filler, size = [*filler, *pieces], size + at
                break
            # whole documents first, the greatest that fits
            for piece in sorted(filler, key=lambda p: -len(p[2])):
                if len(piece[2]) <= room:
                    pieces.append(piece)
                    filler = [p for p in filler if p is not piece]
                    room -= len(piece[2])
                    size -= len(piece[2])
            if room >= self.window - self.done + 1:
                taken, filler = _cut(filler, room)
                pieces += taken
                size -= room
            yield pieces
        if size and self.held:  # less than a window
            self._put(size, filler)
            return
        while size:
            part = 1 << (size.bit_length() - 1)
            done, filler = _cut(filler, part)
            size -= part
            yield done


def _cut(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``size`` ids of some pieces (document, start, ids, ...), and the others."""
    taken, k = [], 0
    while size:
        piece = pieces[k]
        n = len(piece[2])
        if n <= size:
            taken.append(piece)
            size -= n
            k += 1
        else:
            taken.append((piece[0], piece[1], piece[2][:size], *piece[3:]))
            pieces = [*pieces[:k], (piece[0], piece[1] + size, piece[2][size:], *piece[3:]), *pieces[k + 1 :]]
            size = 0
    return taken, pieces[k:]


SCHEMA = "doc_id long, start long, ids binary, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents of ``docs(doc_id, text)``: see SCHEMA; ``ids`` are little-endian unsigned 32-bit.

    A document is its ids and END; each id lies in one piece. Sequences have ``window`` ids at most and are to be padded
    to that, unless a power of two. A null text is empty, so one END. Repeated rows and null ids are packed like others;
    other columns are ignored; an empty table gives an empty table. ``sequence_id`` names the partition (high bits) and
    the sequence in it. ``tokenizer`` is the path of a ``tokenizers`` file on every executor; by default each finds its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _worker_tokenizer(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        packer = Packer(window)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc, start, raw if with_ids else b"", len(ids), zlib.crc32(raw), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        for batch in (part for whole in batches for part in slices(whole)):
            for doc, raw in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(encode(raw.decode("utf-8", "replace")), np.uint32(END))
                full = len(ids) // window * window
                for at in range(0, full, window):
                    emit([(doc, at, ids[at : at + window], len(ids))])
                if full < len(ids):
                    for done in packer.add((doc, full, ids[full:].copy(), len(ids))):
                        emit(done)
                if len(rows) >= 1024:
                    yield _batch(rows)
                    rows.clear()
        for pieces in packer.close(0):
            emit(pieces)
        if rows:
            yield _batch(rows)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def _worker_tokenizer(path: str, made: dict[str, Tokenizer] = {}) -> Tokenizer:
    """One tokenizer a Python worker and file; workers outlive tasks."""
    if path not in made:
        made[path] = Tokenizer(path)
    return made[path]

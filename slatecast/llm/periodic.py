"""Periodic runs of words: stretches that repeat themselves at once, found by Lyndon words, and texts with one period kept of each.

Every run holds a Lyndon word of its period's length that is the longest one to begin at its place, under the order of
words or under the opposite one. A stack scanned from right to left gives the longest Lyndon word at each place (it ends
where the next smaller suffix begins). Suffixes are compared, and periods extended to both sides, by how long they agree:
a search by doubling and halving over rolling hashes, whose answer is then held against the words themselves, so that
equal hashes of unequal words do no harm. There is no suffix array. All of it is work within one text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatecast.llm.common import map_batches, mix64, utf8

#: A run takes at least so many words, and its period so many times.
LEAST_WORDS, LEAST_TIMES = 6, 4

_BASE, _MASK = 0xD1342543DE82EF95, (1 << 64) - 1


class Agreement:
    """How far two places of one sequence of numbers agree, ahead and backwards."""

    def __init__(self, ids: list[int]) -> None:
        n = len(ids)
        self.ids, self.n = ids, n
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        self.up = np.multiply.accumulate(powers)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(np.array(ids, np.uint64) + np.uint64(1)) * self.up[:n], out=self.prefix[1:])
        self.known: dict[int, tuple[int, int]] = {}

    @cached_property
    def _lists(self) -> tuple[list[int], list[int]]:
        return self.up.tolist(), self.prefix.tolist()

    def same_hash(self, i: int, j: int, size: int) -> bool:
        up, p = self._lists
        return (p[i + size] - p[i]) * up[j - i] & _MASK == (p[j + size] - p[j]) & _MASK

    def _search(self, most: int, holds: Callable[[int], bool]) -> int:
        """The largest size up to which ``holds`` by its hashes; never less than the true one."""
        low, high = 0, 1
        while high <= most and holds(high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            middle = (low + high) >> 1
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low

    def ahead(self, i: int, j: int) -> int:
        """The number of equal words from ``i`` and from ``j > i`` on.

        What is found for a distance is kept: the next question for it, further left, verifies the words before only.
        """
        ids, d = self.ids, j - i
        begin, end = self.known.get(d, (self.n, self.n))
        if begin <= i <= end:
            return end - i
        stop = i + self._search(self.n - j, lambda size: self.same_hash(i, j, size))
        joins = i < begin <= stop
        upto = begin if joins else stop
        if ids[i:upto] != ids[j : upto + d]:
            stop = next(k for k in range(i, upto) if ids[k] != ids[k + d])
        elif joins:
            stop = end
        self.known[d] = (i, stop)
        return stop - i

    def back(self, i: int, j: int) -> int:
        """The number of equal words just before ``i`` and just before ``j > i``."""
        size = self._search(i, lambda size: self.same_hash(i - size, j - size, size))
        if self.ids[i - size : i] != self.ids[j - size : j]:
            size = next(k for k in range(size) if self.ids[i - k - 1] != self.ids[j - k - 1])
        return size


def next_smaller(order: list[int], agree: Agreement) -> list[int]:
    """For each place where the next smaller suffix begins; ``order`` ranks the words, and the end is less than any word."""
    n = len(order)
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        word, j = order[i], i + 1
        while j < n:
            other = order[j]
            if other < word:
                break
            if other == word:
                k = 1  # mostly the next words tell
                if j + k < n and order[i + k] == order[j + k]:
                    k = agree.ahead(i, j)
                if j + k == n or order[j + k] < order[i + k]:
                    break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(words: list[bytes], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``least`` words and ``times`` (2 or more) periods, by start and period."""
    n = len(words)
    if n < max(least, times):
        return []
    number = dict(zip(words, range(n), strict=True))
    if len(number) == n:
        return []
    ids = list(map(number.__getitem__, words))
    agree, found = Agreement(ids), set()
    place = np.arange(n)
    for order in (ids, [-x for x in ids]):
        period = np.array(next_smaller(order, agree)) - place
        # a run holds its Lyndon word ``times - 1`` times over, counted from the word's first place
        i = np.flatnonzero(place + (times - 1) * period <= n)
        p = period[i]
        size = (times - 2) * p
        prefix, up = agree.prefix, agree.up
        same = (prefix[i + size] - prefix[i]) * up[p] == prefix[i + p + size] - prefix[i + p]
        done: dict[int, int] = {}
        for i, p in zip(i[same].tolist(), p[same].tolist(), strict=True):
            if i + (times - 1) * p <= done.get(p, 0):
                continue
            start = i - agree.back(i, i + p)
            end = i + p + agree.ahead(i, i + p)
            done[p] = end
            if end - start >= max(least, times * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that any run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Of one document in ten (by its id; a null id counts as the empty text) the words from a place on, made periodic."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_TIMES, change: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row of ``docs(doc_id, text)``; other columns are ignored.

    ``runs`` holds ``(start, length, period)``, counted in words, by start and period; ``collapsed`` is the text with one
    period kept of each run, its words joined by single spaces. Words are what ASCII white space parts, letters as they
    stand. A null or blank text has no words, no runs and an empty ``collapsed``. Repeated rows each come out, with equal
    values; null ids stay null; an empty table gives an empty table. ``change(words, doc_id)`` may alter the words first.
    A text is read as a whole in the task that has it: its time is in proportion to its words, but for how far equal
    suffixes are compared.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, runs, texts = [], [], []
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = raw.split()
                if change:
                    words = change(words, doc_id)
                found = runs_of(words, least, times)
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), run, strict=True)) for run in found])
                texts.append(b" ".join(collapsed(words, found)))
            kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
            return pa.record_batch([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    made = map_batches(rows, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed binary", make)
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def summarised(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs`` the number of runs, the greatest run (ties: smallest start, then period) and hashes of runs and text."""
    runs = F.col("runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    milli = F.floor(length * 1000 / period).cast("long")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

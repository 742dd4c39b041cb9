"""Links of near rows among those that share a key, where a key may hold any share of all rows.

Of the nodes of a key those near its first node need not be compared with each other, as they are linked already; each
of the others is held against all. A key with more than a task should hold is dealt in blocks: all of them get the first
node, and then the nodes that were not near it meet every block. So no pairs are listed, nothing is left out and no task
gets an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatecast.functions.dealing import dealt
from slatecast.llm.common import checkpoint, release, segments, slices

#: The likeness from which sets are linked, in hundredths.
LIKENESS = 80
#: Shingles of sets that one task compares at once.
MOST_SHINGLES = 1 << 21
#: Pairs that are compared in one go.
PAIRS = 1 << 17


class Loads(Protocol):
    """What the rows of one task bear; ``near`` tells which pairs are linked. Each weighs one if ``EVEN``, else its size.

    Instead of ``near`` there may be ``against``, which finds what ``near_pairs`` gives without listing all pairs.
    """

    EVEN: bool

    def __init__(self, loads: list, sizes: np.ndarray) -> None: ...

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray: ...


class Forest:
    """Least linked index of each index, for links that come in batches."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        up = self.up
        while True:
            x, y = up[i], up[j]
            differ = x != y
            if not differ.any():
                return
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up, nxt := up[up]):
                up = nxt
            self.up = up


class Sets:
    """Whole sets of one task; ``near`` compares them exactly. A load is the sorted shingles' bytes, and weighs as many as there are."""

    EVEN = False

    def __init__(self, loads: list[bytes], sizes: np.ndarray) -> None:
        self.sizes = sizes
        known, self.flat = np.unique(np.frombuffer(b"".join(loads), np.uint64), return_inverse=True)
        self.starts, _ = segments(sizes)
        self.mark = np.zeros(len(known), bool)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``i`` should come in runs, as each set is laid out once a run."""
        ok = sizes_allow(self.sizes[i], self.sizes[j])
        at = np.flatnonzero(ok)
        if not len(at):
            return ok
        heads = np.flatnonzero(np.concatenate([[True], i[at][1:] != i[at][:-1]]))
        for run in np.split(at, heads[1:]):
            one = i[run[0]]
            mine = self.flat[self.starts[one] : self.starts[one] + self.sizes[one]]
            self.mark[mine] = True
            for some in np.array_split(run, max(1, int(self.sizes[j[run]].sum()) >> 20)):
                begin, of = segments(self.sizes[j[some]])
                hits = np.bincount(of, self.mark[self.flat[np.arange(len(of)) - begin[of] + self.starts[j[some]][of]]], minlength=len(some)).astype(np.int64)
                ok[some] = 100 * hits >= LIKENESS * (self.sizes[one] + self.sizes[j[some]] - hits)
            self.mark[mine] = False
        return ok


def sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= LIKENESS * np.maximum(a, b)


def links_of(node: np.ndarray, key: np.ndarray, lead: np.ndarray, loads: Loads) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs that link rows sorted by ``key``, and the rows of keys with leads that are near none of them.

    The rows that ``lead`` marks are held against all of their key. Where a key has none, its first row is, and then
    those that are not near it are.
    """
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(heads, len(key)))
    _, of = segments(sizes)
    forest = Forest(len(node))
    led = np.zeros(len(heads), bool)
    led[of[lead]] = True
    rows = np.setdiff1d(np.flatnonzero(~led[of]), heads)
    first, near = ~led & (sizes > 1), np.zeros(len(node), bool)
    for i, j in near_pairs(loads, heads[first], heads[first], sizes[first]):
        forest.add(i, j)
        near[j] = True
    todo = np.sort(np.concatenate([rows[~near[rows]], np.flatnonzero(lead)]))
    reached = lead | ~led[of]
    for i, j in near_pairs(loads, todo, heads[of[todo]], sizes[of[todo]]):
        forest.add(i, j)
        reached[j] = True
    linked = np.flatnonzero(forest.up != np.arange(len(node)))
    return forest.up[linked], linked, np.flatnonzero(~reached)


def near_pairs(loads: Loads, rows: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of each of ``rows`` with all rows near it among the ``sizes`` ones from ``begin`` on, its key's; each of these comes second in one."""
    if not len(rows):
        return
    if hasattr(loads, "against"):
        yield from loads.against(rows, begin, sizes)
        return
    costs = np.cumsum(sizes)
    for some in np.split(np.arange(len(rows)), np.searchsorted(costs, np.arange(PAIRS, costs[-1], PAIRS))):
        starts, which = segments(sizes[some])
        i = rows[some][which]
        j = begin[some][which] + np.arange(len(which)) - starts[which]
        i, j = i[i != j], j[i != j]
        found = loads.near(i, j)
        yield i[found], j[found]


def compare(rows: DataFrame, kind: type[Loads], most: int, keys: list[str]) -> DataFrame:
    """``(key, a, b)`` of ``rows(*keys, lead, node, size, load)``: links of nodes, and ``(key, a, a)`` where a node is near none that leads.

    A task holds whole keys, one after the other, a few small ones at a time.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def flush() -> pa.RecordBatch:
            key, lead, node, size, loads = zip(*held, strict=True)
            change = np.concatenate([[0], np.cumsum([x != y for x, y in zip(key, key[1:], strict=False)])])
            node, first = np.array(node, np.int64), np.array([k[0] for k in key], np.int64)
            a, b, apart = links_of(node, change, np.array(lead, bool), kind(list(loads), np.array(size, np.int64)))
            out = [np.concatenate(x) for x in ((first[b], first[apart]), (node[a], node[apart]), (node[b], node[apart]))]
            return pa.record_batch([pa.array(x) for x in out], ["key", "a", "b"])

        for batch in (part for whole in batches for part in slices(whole)):
            columns = [batch[c].to_pylist() for c in ("lead", "node", "size", "load")]
            for key, *row in zip(zip(*(batch[k].to_pylist() for k in keys), strict=True), *columns, strict=True):
                same = bool(held) and held[-1][0] == key
                if not same and weight >= most:
                    yield flush()
                    held, weight = [], 0
                if not same or held[-1][2] != row[1]:  # of a node that leads and is led, or has copies, one row will do
                    held.append((key, *row))
                    weight += 1 if kind.EVEN else row[2]
        if held:
            yield flush()
        release()

    placed = dealt(rows.select(*keys, "lead", "node", "size", "load"), *keys, parts=parts)
    return placed.sortWithinPartitions(*keys, "node", F.col("lead").desc()).mapInArrow(run, "key long, a long, b long")


def linked_within(rows: DataFrame, kind: type[Loads], most: int, sized: DataFrame | None = None) -> DataFrame:
    """Links ``(a, b)`` with the components of all near pairs that share a key, of ``rows(key, node, size, load)``.

    ``kind`` says what loads are, what they weigh and when two are near. Of a key that weighs more than ``most`` the first
    node is held against every block; those that are not near it, in blocks too, are then held against every block.
    Rows are read more than once. Where that is dear, ``sized(key, node, size)`` tells what keys weigh, and only rows of
    keys that weigh too much are written.
    """
    weight = F.lit(1) if kind.EVEN else F.col("size")
    led = rows.withColumn("lead", F.lit(False))
    heavy = (rows if sized is None else sized).groupBy("key").agg(F.sum(weight).alias("weight"), F.min("node").alias("first")).where(F.col("weight") > most)
    heavy = checkpoint(heavy.select("key", "first", F.ceil(F.col("weight") / most).cast("int").alias("blocks")))
    if heavy.isEmpty():
        return compare(led, kind, most, ["key"]).select("a", "b").distinct()
    light = compare(led.join(heavy, "key", "left_anti"), kind, most, ["key"])
    blocks = led.join(heavy, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    if sized is not None:
        blocks = checkpoint(blocks)
    firsts = blocks.where("node = first").dropDuplicates(["key"]).withColumns({"lead": F.lit(True), "block": _each("blocks")})
    turn = checkpoint(compare(blocks.unionByName(firsts), kind, most, ["key", "block"]))
    strays = blocks.join(turn.where("a = b").select("key", F.col("a").alias("node")).distinct(), ["key", "node"])
    stray_blocks = strays.groupBy("key").agg(F.ceil(F.sum(weight) / most).cast("int").alias("stray_blocks"))
    rest = strays.join(stray_blocks, "key").withColumns({"lead": F.lit(True), "part": F.pmod(F.xxhash64("node", F.lit(1)), F.col("stray_blocks")).cast("int"), "block": _each("blocks")})
    against = blocks.join(stray_blocks, "key").withColumn("part", _each("stray_blocks"))
    last = compare(rest.unionByName(against), kind, most, ["key", "part", "block"])
    return light.unionByName(turn).unionByName(last).where("a != b").select("a", "b").distinct()


def _each(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

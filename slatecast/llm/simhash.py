"""SimHash near-duplicates through a binary-trie self-join.

Equal fingerprints are one class, so the join works on distinct fingerprints. A pair within ``budget`` bits agrees on
at least ``blocks - budget`` of ``blocks`` blocks; each choice of blocks deals the fingerprints by their bits in it.
Within such a group a binary trie is joined with itself: pairs of nodes are walked down together, differing bits are
added up, and a pair whose sum exceeds the budget is dropped with all that hangs below it. Only a spanning forest of
each task's links is passed on (at most one link a fingerprint), and the components of those links are the groups.

``copy_groups`` groups by likeness of shingle sets. Its candidates come from the same join: fingerprints dealt by blocks of
bits and joined by the trie. At a likeness of 0.8 some ten of 64 bits differ, for which blocks of bits would be too short
to tell texts apart, so the fingerprints are also dealt by least hashes of the shingles, and each such key's trie is joined
within a wide budget of bits. The shingle sets of what is linked are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatecast.llm.common import checkpoint, map_batches, mix64, release, segments, utf8, words
from slatecast.llm.components import connected_components
from slatecast.llm.within import MOST_SHINGLES, Forest, Sets, linked_within

SHINGLE_WORDS, SEED, BUDGET = 4, 42, 4
#: Node pairs walked in one go, the number of fingerprint pairs from which a node pair is split, not listed, and pairs listed in one go.
WALK_PAIRS, LIST_PAIRS, LISTED = 1 << 18, 48, 1 << 20
#: Parts, at least, by which the rows of one component are dealt.
PARTS_OF_A_COMPONENT = 64
#: Near copies: words in a shingle, and the bits that may differ (at a likeness of 0.8 about 9.7 on average, with a standard
#: deviation of 2.9); what one task compares at once of their fingerprints.
COPY_WORDS, COPY_BUDGET, MOST_PRINTS = 5, 22, 1 << 16
#: Least hashes to a key, and keys: of two texts that are alike to 0.8 all keys differ with a chance of (1 - 0.8**5)**25 = 5e-5.
KEY_HASHES, KEYS = 5, 25


def fingerprint(raw: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text; 0 without words, the whole sequence's shingle if words are too few."""
    return simhash(shingle_hashes(raw, width, seed))


def shingle_hashes(raw: bytes, width: int, seed: int = SEED) -> list[int]:
    """The hash of each shingle in order; none without words, the whole sequence's if words are too few."""
    tokens = words(raw)
    if not tokens:
        return []
    line = b" ".join(tokens)
    if len(tokens) < width:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(tokens) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def simhash(hashes: list[int]) -> int:
    """The bits that more than half of the hashes have; 0 of none."""
    ones = np.zeros(64, np.int64)
    all_hashes = np.array(hashes, ">u8").view(np.uint8)
    for at in range(0, len(all_hashes), 8 << 16):  # so that a very long text takes little memory
        ones += np.unpackbits(all_hashes[at : at + (8 << 16)]).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every document; ``fp`` holds the 64 bits as a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = np.array([fingerprint(x) for x in batch["text"].to_pylist()], np.uint64).view(np.int64)
            return pa.record_batch([batch["doc_id"], pa.array(made)], ["doc_id", "fp"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), utf8()), "doc_id long, fp long", make)


def block_masks(budget: int, count: int) -> list[int]:
    """Bit masks such that any two fingerprints within ``budget`` bits agree on all bits of one at least.

    More fingerprints take more, smaller blocks, hence longer keys, so that the groups stay small.
    """
    blocks = budget + (1 if count < 50_000_000 else 2 if count < 5_000_000_000 else 4)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - budget)]


def trie_links(values: np.ndarray, group: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``values`` (unsigned, sorted and distinct within each run of ``group``) within ``budget`` bits."""
    if not len(values):
        return
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    tails = np.concatenate([heads[1:], [len(values)]])
    keep = tails - heads > 1
    yield from trie_walk(values, heads[keep], tails[keep], heads[keep], tails[keep], budget)


def trie_walk(values: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits, of ranges ``a0`` to ``a1`` with ``b0`` to ``b1`` of ``values``: the same ones, or such that lie behind.

    Values of a range are sorted and distinct.
    """
    zero = np.zeros(len(a0), np.int64)
    stack = [(0, *(x[i : i + WALK_PAIRS] for x in (a0, a1, b0, b1, zero))) for i in range(0, len(a0), WALK_PAIRS)]
    while stack:
        depth, a0, a1, b0, b1, off = stack.pop()
        size = (a1 - a0) * (b1 - b0)
        small = (size <= LIST_PAIRS) | (depth == 64)
        if small.any():
            lists = np.stack([a0[small], b0[small], (b1 - b0)[small], size[small]])
            for i0, j0, wide, n in np.split(lists, np.unique(np.searchsorted(np.cumsum(lists[3]), np.arange(LISTED, lists[3].sum(), LISTED))), axis=1):
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, j = np.repeat(i0, n) + at // np.repeat(wide, n), np.repeat(j0, n) + at % np.repeat(wide, n)
                near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
                if near.any():
                    yield i[near], j[near]
            a0, a1, b0, b1, off = (x[~small] for x in (a0, a1, b0, b1, off))
        if not len(a0):
            continue
        bit = np.uint64(1 << (63 - depth))
        am, bm = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        same = a0 == b0
        pieces = []
        for (x0, x1), (y0, y1), step, mask in (((a0, am), (b0, bm), 0, None), ((am, a1), (bm, b1), 0, None), ((a0, am), (bm, b1), 1, None), ((am, a1), (b0, bm), 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (off + step <= budget)
            if mask is not None:
                ok &= mask
            pieces.append((x0[ok], x1[ok], y0[ok], y1[ok], off[ok] + step))
        joined = [np.concatenate(x) for x in zip(*pieces, strict=True)]
        for i in range(0, len(joined[0]), WALK_PAIRS):
            stack.append((depth + 1, *(x[i : i + WALK_PAIRS] for x in joined)))


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """For node ranges whose values agree above ``bit``: the first index with the bit set."""
    low, end = low.copy(), high.copy()
    while (going := np.flatnonzero(low < end)).size:
        middle = (low[going] + end[going]) >> 1
        is_set = (values[middle] & bit) != 0
        end[going] = np.where(is_set, middle, end[going])
        low[going] = np.where(is_set, low[going], middle + 1)
    return low


def near_links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links ``(a, b)`` of distinct fingerprints ``fps(fp)`` with the components of all pairs within ``budget`` bits."""
    spark = fps.sparkSession
    count = fps.count()
    masks = block_masks(budget, count)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count * len(masks) // 1_000_000 + 1)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(signed)]))
    dealt = fps.select("fp", keys.alias("key")).select("fp", "key.choice", "key.part").repartition(parts, "choice", "part")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        fp, choice, part = (table[c].to_numpy() for c in ("fp", "choice", "part"))
        values = fp.view(np.uint64)
        order = np.lexsort((values, part, choice))
        values, choice, part = values[order], choice[order], part[order]
        new = np.concatenate([[True], (choice[1:] != choice[:-1]) | (part[1:] != part[:-1])])
        forest = Forest(len(values))
        for i, j in trie_links(values, np.cumsum(new), budget):
            forest.add(i, j)
        linked = np.flatnonzero(forest.up != np.arange(len(values)))
        yield pa.record_batch([values[forest.up[linked]].view(np.int64), values[linked].view(np.int64)], ["a", "b"])
        release()

    return dealt.mapInArrow(join, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``; other columns are ignored.

    A null text is empty; texts without words have fingerprint zero and are linked like any others. Repeated rows each
    come out. A row with a null id keeps its place in its group, but never names it; a group of such rows alone has a
    null ``component_id``. An empty table gives an empty table.
    """
    marked = checkpoint(with_fingerprints(docs))
    firsts = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    grouped = connected_components(near_links(firsts.select("fp"), budget)).withColumnRenamed("node", "fp")
    # a component may hold a third of all: its least id is taken, and given back, by parts of it
    ways = max(PARTS_OF_A_COMPONENT, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    classes = firsts.join(grouped, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"), F.pmod(F.xxhash64("fp"), F.lit(ways)).alias("part"))
    least = classes.groupBy("component", "part").agg(F.min("first").alias("least"))
    least = least.groupBy("component").agg(F.min("least").alias("component_id"), F.collect_list("part").alias("parts"))
    named = classes.join(least.withColumn("part", F.explode("parts")), ["component", "part"]).select("fp", "component_id")
    return marked.join(named, "fp", "left").select("doc_id", F.format_string("%016x", "fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The documents less those whose group has a smaller id; of rows that share the least id all stay but repeats.

    Columns are as before. Rows with a null id stay, as they cannot be told apart. The pipeline takes ``one_of_copies``.
    """
    gone = near_duplicates(docs, budget).where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))  # packed, so that no name clashes
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")


_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, KEY_HASHES * KEYS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64))


def copy_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles, each made of the least values of some orders of them; an empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(KEY_HASHES * KEYS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):  # so that a very long text takes little memory
        np.minimum(least, ((found[at : at + 4096] ^ _DRAWS[0]) * _DRAWS[1]).min(axis=1), out=least)
    key = np.arange(KEYS, dtype=np.uint64)
    for part in least.reshape(KEYS, KEY_HASHES).T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


def _sets(docs: DataFrame) -> DataFrame:
    """``(id, h, node, fp, keys, size)`` of every row: ``node`` names its set of ``size`` shingles, ``h`` is a hash of its text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for raw in batch["text"].to_pylist():
                hashes = shingle_hashes(raw, COPY_WORDS)
                found = shingle_set(hashes)
                node = xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0
                rows.append((node, simhash(hashes), copy_keys(found), len(found)))
            node, fp, keys, size = zip(*rows, strict=True)
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            return pa.record_batch([batch["id"], batch["h"], *signed, pa.array(keys, pa.list_(pa.int64())), pa.array(size, pa.int64())], ["id", "h", "node", "fp", "keys", "size"])

        return step

    return map_batches(_with_key(docs).select("id", "h", "text"), "id long, h long, node long, fp long, keys array<long>, size long", make)


def _with_key(docs: DataFrame) -> DataFrame:
    """Each row as a struct, its text's bytes, its id and a hash of text and of whether there is an id."""
    row_id = F.col("doc_id").cast("long")
    rows = docs.select(F.struct("*").alias("row"), row_id.alias("id"), utf8())  # packed, so that no name clashes
    return rows.select("row", "text", "id", F.xxhash64(F.col("id").isNull(), "text").alias("h"))


class Prints:
    """Fingerprints of one task; near are those within COPY_BUDGET bits, found by joining the tries of a key's rows."""

    EVEN = True

    def __init__(self, loads: list[int], sizes: np.ndarray) -> None:
        self.values = np.array(loads, np.int64).view(np.uint64)

    def against(self, rows: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links as ``within.near_pairs`` has them: equal fingerprints are one node of a trie, whose rows hang on the first of them."""
        heads, first = np.unique(begin, return_index=True)
        starts, of = segments(sizes[first])
        values, ends, row, copies = self._trie(np.arange(len(of)) - starts[of] + heads[of], of, len(heads))
        asked, asked_ends, asking, _ = self._trie(rows, np.searchsorted(heads, begin), len(heads))
        n, hit = len(values), np.zeros(len(values), bool)
        for j, i in trie_walk(np.concatenate([values, asked]), ends[:-1], ends[1:], n + asked_ends[:-1], n + asked_ends[1:], COPY_BUDGET):
            hit[j] = True
            i, j = asking[i - n], row[j]
            yield i[i != j], j[i != j]
        of, copy = copies
        yield row[of[hit[of]]], copy[hit[of]]

    def _trie(self, rows: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Sorted distinct values of each group, where groups begin and end, a row of each value, and the other rows with the value's place."""
        order = np.lexsort((rows, self.values[rows], group))
        rows, group = rows[order], group[order]
        values = self.values[rows]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (values[1:] != values[:-1])])
        return values[new], np.searchsorted(group[new], np.arange(groups + 1)), rows[new], ((np.cumsum(new) - 1)[~new], rows[~new])


class Copies(Sets):
    """Sets of shingles of one task, compared exactly. A load is a text, which takes less room on the way than its set."""

    def __init__(self, loads: list[bytes], sizes: np.ndarray) -> None:
        super().__init__([shingle_set(shingle_hashes(raw, COPY_WORDS)).tobytes() for raw in loads], sizes)


def copy_links(nodes: DataFrame, most: int = MOST_PRINTS) -> DataFrame:
    """Links ``(a, b)`` of ``nodes(node, fp, keys)`` with the components of all pairs that share a key and differ in COPY_BUDGET bits at most."""
    return linked_within(nodes.select(F.explode("keys").alias("key"), "node", F.lit(1).cast("long").alias("size"), F.col("fp").alias("load")), Prints, most)


def bit_links(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` with the components of all ``nodes(node, fp)`` whose fingerprints are within BUDGET bits, from the join of ``near_links``.

    Fingerprints are nodes of this graph, too. One that has the number of a node joins two groups of candidates, which
    the exact comparison parts again.
    """
    prints = checkpoint(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    near = checkpoint(near_links(prints.select("fp")))
    met = near.select(F.col("a").alias("fp")).union(near.select("b")).union(prints.where("n > 1").select("fp")).distinct()
    return near.unionByName(nodes.join(met, "fp", "left_semi").select(F.col("node").alias("a"), F.col("fp").alias("b")))


def candidates(nodes: DataFrame, most: int = MOST_PRINTS) -> DataFrame:
    """``(node, component)`` of the ``nodes(node, fp, keys, size)`` that are near others by blocks of bits, or by keys and more bits.

    Fingerprints stand among the nodes, too (see ``bit_links``).
    """
    return connected_components(bit_links(nodes.where("size > 0")).unionByName(copy_links(nodes, most)))


def copy_groups(docs: DataFrame, most_prints: int = MOST_PRINTS, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """``(node, component, pick)``: every set of shingles in ``docs``, its group of near copies, and its first row as ``pick(nameless, id, h)``.

    Linked are sets of a Jaccard likeness of LIKENESS hundredths or more; texts without words are one set. Keys and groups
    of candidates that are more than ``most_prints`` and ``most_shingles`` are compared in blocks.
    """
    marked = checkpoint(_sets(docs))
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "h")).alias("pick")
    nodes = checkpoint(marked.groupBy("node").agg(first, F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.min("size").alias("size")))
    wanted = checkpoint(candidates(nodes, most_prints).join(nodes.select("node", "size", *_named("pick.id", "pick.h")), "node").withColumnRenamed("component", "key"))
    texts = _with_key(docs).select("text", *_named("id", "h")).join(wanted, NAME).select("key", "node", "size", F.col("text").alias("load"))
    apart = connected_components(linked_within(texts, Copies, most_shingles, wanted))
    return nodes.select("node", "pick").join(apart, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "pick")


#: Columns by which a row is found again, none of them null.
NAME = ["nameless", "own_id", "own"]


def _named(row_id: str, h: str) -> list[Column]:
    return [F.col(row_id).isNull().alias(NAME[0]), F.coalesce(F.col(row_id), F.lit(0)).alias(NAME[1]), F.col(h).alias(NAME[2])]


def one_of_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies (see ``copy_groups``), of the least id, a null id being the greatest; columns stay.

    All else in the group goes, and nothing else: repeated rows leave one, rows with a null id go if the group has
    another row, and of an id with two texts each is judged by itself.
    """
    kept = copy_groups(docs).groupBy("component").agg(F.min("pick").alias("pick")).select(*_named("pick.id", "pick.h"))
    rows = _with_key(docs).select("row", *_named("id", "h")).join(kept, NAME, "left_semi")
    # the window asks for the join's own partitions, so texts are not shuffled again
    alike = Window.partitionBy(*NAME).orderBy(F.xxhash64("row"))
    return rows.withColumn("nth", F.row_number().over(alike)).where("nth = 1").select("row.*")

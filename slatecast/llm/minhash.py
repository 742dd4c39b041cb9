"""Near duplicates by MinHash bands, odd sketches and exact likeness of shingle sets.

Equal sets are one node. Nodes that share a band of least hashes meet. Whether such nodes may be alike is told by odd
sketches: MinHash samples (the least shingle of each of many bins) are folded into a bitmap of parities, so that the bits
in which two bitmaps differ estimate how many samples do, precisely where likeness is high. What the sketches do not rule
out is compared on the full sets.

Both comparisons go through ``linked_within``, whose keys are bands and then groups of candidates, however many nodes share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatecast.llm.common import checkpoint, map_batches, mix64, utf8
from slatecast.llm.components import connected_components
from slatecast.llm.simhash import PARTS_OF_A_COMPONENT, shingle_hashes, shingle_set
from slatecast.llm.within import MOST_SHINGLES, Sets, linked_within, sizes_allow

#: Words in a shingle.
SHINGLE_WORDS = 4
#: Two sets alike to 0.8 share none of the bands with a chance of (1 - 0.8**4)**30 = 1.4e-7.
BAND_HASHES, BANDS = 4, 30
#: Bins that give a sample each, and bits of a sketch, as powers of two.
BIN_BITS, SKETCH_BITS = 9, 10
#: Sketches that tell of less are ruled out: six standard deviations (0.024) under 0.8.
LEAST_ESTIMATE = 0.65
#: Sketches that one task compares at once.
MOST_SKETCHES = 8192

_DRAWS = np.random.default_rng(7).integers(0, 1 << 63, (2, BAND_HASHES * BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles, each made of the least values of BAND_HASHES orders of them; an empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BAND_HASHES * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):  # what fits into a core's cache
        np.minimum(least, ((found[at : at + 512] ^ _DRAWS[0]) * _DRAWS[1]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, BAND_HASHES).T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


def odd_sketch(found: np.ndarray) -> tuple[bytes, int]:
    """The parities of a sorted set's samples by their hashed bit, and the number of samples."""
    bins = found >> np.uint64(64 - BIN_BITS)
    samples = found[np.concatenate([[True], bins[1:] != bins[:-1]])] if len(found) else found
    bits = np.bincount((mix64(samples) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
    return np.packbits((bits & 1).astype(np.uint8)).tobytes(), len(samples)


class Sketches:
    """Sketches of one task; ``near`` tells which pairs may be alike. A load is the sketch and its number of samples."""

    EVEN = True

    def __init__(self, loads: list[bytes], sizes: np.ndarray) -> None:
        made = np.frombuffer(b"".join(loads), np.uint8).reshape(len(loads), (1 << SKETCH_BITS) // 8 + 2)
        self.bits = np.ascontiguousarray(made[:, :-2]).view(np.uint64)
        self.samples = np.ascontiguousarray(made[:, -2:]).view(np.uint16).ravel().astype(np.int64)
        self.sizes = sizes

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = sizes_allow(self.sizes[i], self.sizes[j])
        at = np.flatnonzero(ok)
        differ = np.bitwise_count(self.bits[i[at]] ^ self.bits[j[at]]).sum(axis=1, dtype=np.int64)
        ok[at] = estimate(differ, self.samples[i[at]], self.samples[j[at]]) >= LEAST_ESTIMATE
        return ok


def estimate(differ: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The likeness of sets whose sketches of ``a`` and ``b`` samples differ in so many bits; rather more than less."""
    bits = 1 << SKETCH_BITS
    unlike = -bits / 2 * np.log(np.maximum(1 - 2 * differ / bits, 1e-9))  # samples of one that the other lacks
    same = np.maximum(a + b - unlike, 0) / 2
    return same / np.maximum(same + unlike / 2, 1e-9)


def _rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, text)``: ids, a hash of the text, and its bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).select("doc_id", F.xxhash64("text").alias("h"), "text")


def _marked(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, set, size, load, keys)`` of every row: the name of its set of shingles (null without words), its size, sketch and bands."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for raw in batch["text"].to_pylist():
                found = shingle_set(shingle_hashes(raw, SHINGLE_WORDS))
                sketch, samples = odd_sketch(found)
                name = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                out.append((name, len(found), sketch + samples.to_bytes(2, "little"), band_keys(found)))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            return pa.record_batch([batch["doc_id"], batch["h"], *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "h", "set", "size", "load", "keys"])

        return step

    return map_batches(_rows(docs), "doc_id long, h long, set binary, size long, load binary, keys array<long>", make)


def _with_sets(texts: DataFrame) -> DataFrame:
    """``(key, node, size, load)`` of ``texts(key, node, text)``: the whole sets."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(shingle_hashes(raw, SHINGLE_WORDS)) for raw in batch["text"].to_pylist()]
            return pa.record_batch([batch["key"], batch["node"], pa.array(map(len, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "node", "size", "load"])

        return step

    return map_batches(texts.select("key", "node", "text"), "key long, node long, size long, load binary", make)


def alike(docs: DataFrame, nodes: DataFrame, most_sketches: int = MOST_SKETCHES, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """``(node, component)`` of the ``nodes`` that are linked to others, by bands, sketches and then whole sets."""
    pairs = nodes.select("node", F.explode("keys").alias("key"))
    shared = checkpoint(pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    meeting = checkpoint(pairs.join(shared, "key").join(nodes.select("node", "size", "load"), "node").select("key", "node", "size", "load"))
    candidates = connected_components(linked_within(meeting, Sketches, most_sketches))
    wanted = candidates.join(nodes.select("node", "pick"), "node").select("node", F.col("component").alias("key"), F.col("pick.doc_id").alias("of"), F.col("pick.h").alias("own"))
    texts = _rows(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("own")))
    return connected_components(linked_within(checkpoint(_with_sets(texts)), Sets, most_shingles))


def near_duplicates(docs: DataFrame, most_sketches: int = MOST_SKETCHES, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``; other columns are ignored.

    Linked are rows whose sets of shingles are alike to LIKENESS hundredths or more; a component is called by its least id.
    Null, empty and blank texts have no shingles and are linked with nothing, each named by its own id; a text of fewer
    words than a shingle has is one shingle. Repeated rows each come out. A row with a null id keeps its place in its
    group, but never names it; where all ids of a group are null, its name is null. ``kept`` is whether a row's id is
    its group's name, so all rows of that id are (and rows without an id in a group without a name). An empty table gives
    an empty table.
    """
    marked = checkpoint(_marked(docs))
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h")).alias("pick")
    sets = marked.where("set is not null").groupBy("set").agg(pick, F.first(F.struct("size", "load", "keys")).alias("of"))
    nodes = checkpoint(sets.select(F.monotonically_increasing_id().alias("node"), "set", "pick", "of.*"))
    grouped = alike(docs, nodes, most_sketches, most_shingles)
    # a component may hold a third of all: its least id is taken, and given back, by parts of it
    ways = max(PARTS_OF_A_COMPONENT, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    classes = nodes.join(grouped, "node", "left").select("set", F.col("pick.doc_id").alias("first"), F.coalesce("component", "node").alias("component"), F.pmod(F.xxhash64("node"), F.lit(ways)).alias("part"))
    least = classes.groupBy("component", "part").agg(F.min("first").alias("least"))
    least = least.groupBy("component").agg(F.min("least").alias("least"), F.collect_list("part").alias("parts"))
    named = classes.join(least.withColumn("part", F.explode("parts")), ["component", "part"]).select("set", "least")
    found = marked.select("doc_id", "set", "size").join(named, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: Shingles are joined with themselves, so this is for small tables.
ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda k: array_to_string(words[k:k + 3], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM texts),
flat AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id != b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON p.a = r.other)
SELECT s.doc_id, len(s.shingles) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
"""

"""Mixing sources to target weights by Sainte-Laguë apportionment.

All targets are cut into blocks of equal size. Blocks go to sources, and a source's blocks to its shards, by highest
quotients size / (2 k + 1): the k-th further block goes where that is greatest. Shards hold documents by hash; within a
shard the documents lie in seeded order on a ring, and the shard's quota of blocks is laid on it from a seeded place
on, so that each word is taken the same number of times, but for one. Only ids and sizes are shuffled, and no shard
holds more than its share of a source, however large that is.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from slatecast.llm.common import by_slices, checkpoint, utf8

WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
#: Words in a block, words in a shard as long as there are fewer than SHARDS of these, and the seed of all choices.
BLOCK, SHARD_WORDS, SHARDS, SEED = 16, 4_000, 65_536, 17


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(column: str = "text") -> Column:
    """How many words (runs of other than ASCII white space) a text has; null has none."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(F.col(column), r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", "")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """What each source should give: its weight's part of ``share`` times all, at most ``most`` times its size.

    What is beyond that is shared again by weight among the rest until nobody is above; sources' weights repeat.
    """
    each = [Fraction(weights[k % len(weights)]) for k in range(len(sizes))]
    left, capped = share * sum(sizes), set()
    while True:
        total = sum(w for k, w in enumerate(each) if k not in capped)
        over = {k for k, w in enumerate(each) if k not in capped and left * w / total > most * sizes[k]} if total else set()
        if not over:
            return [Fraction(most * sizes[k]) if k in capped else left * w / total if total else Fraction(0) for k, w in enumerate(each)]
        capped |= over
        left -= sum(most * sizes[k] for k in over)


def apportion(shares: np.ndarray, blocks: int, limit: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: ``blocks`` seats by highest quotients shares / (2 k + 1), nobody above ``limit``; ties go to the first.

    The least quotient that still gets a seat is searched for, which gives the same seats as going from the highest
    quotient down; what ties at it is dealt in order.
    """
    shares = np.asarray(shares, np.float64)
    blocks = int(min(blocks, limit[shares > 0].sum()))
    if blocks <= 0:
        return np.zeros(len(shares), np.int64)

    def seats(cut: float) -> np.ndarray:  # quotients of at least cut
        with np.errstate(over="ignore"):
            return np.minimum(np.floor(np.minimum((shares / cut + 1) / 2, 2**62)).astype(np.int64), limit)

    low, high = shares[shares > 0].min() / (4.0 * blocks + 4 * limit.max() + 4), shares.max() * 2
    for _ in range(200):
        middle = math.sqrt(low * high)
        if not low < middle < high:
            break
        if seats(middle).sum() >= blocks:
            low = middle
        else:
            high = middle
    out = seats(high)
    rest = blocks - int(out.sum())
    while rest > 0:  # all of those that tie get one each, in order
        quotient = np.where(out < limit, shares / (2 * out + 1), -1.0)
        best = np.flatnonzero(quotient >= quotient.max() * (1 - 1e-15))[:rest]
        out[best] += 1
        rest -= len(best)
    return out


def _draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), utf8())


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, source, draw, place, ring, first, quota)`` for every row of ``docs``.

    ``taken`` words of the document are in the mix: those of its places on its shard's ring that the quota covers, of
    which the later columns tell (see ``taken_before``). Sources go by code point, null last and a source of its own,
    and take part even with no words. A null text has size 0; repeated rows are rows of their own; other columns are
    ignored; an empty table gives an empty table. Reruns give the same rows.
    """
    source = docs["source"].cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), n_words().alias("size"), _draw(seed).alias("draw"))
    rows = checkpoint(rows)
    per_source = rows.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()  # a row a source
    sizes = [int(r["n"]) for r in per_source]
    wanted = targets(sizes)
    total = sum(sizes)
    shard = max(shard_words, total // SHARDS + 1)
    n_shards = [n // shard + 1 for n in sizes]
    spark = docs.sparkSession
    plan = spark.createDataFrame([(r["source"], k, n, float(t), c) for k, (r, n, t, c) in enumerate(zip(per_source, sizes, wanted, n_shards, strict=True))], "source string, k int, source_size long, target double, shards long")
    same = rows["source"].eqNullSafe(plan["source"])
    placed = rows.join(F.broadcast(plan.select("source", "k", "shards")), same).select("doc_id", rows["source"], "size", "draw", "k", F.pmod("draw", "shards").alias("shard"))
    per_shard = placed.groupBy("k", "shard").agg(F.sum("size").alias("ring")).orderBy("k", "shard").toPandas()  # SHARDS rows and one a source at most
    # sources first: equal blocks by highest quotients of the targets, then each source's blocks among its shards
    ring = per_shard["ring"].to_numpy(np.int64)
    room = -(-MOST * ring // block)  # the last block of a shard may be a part of one
    owner = per_shard["k"].to_numpy()
    source_room = np.bincount(owner, room, minlength=len(sizes)).astype(np.int64)
    source_blocks = apportion(np.array([float(t) for t in wanted]), round(sum(wanted) / block), source_room)
    begins = np.searchsorted(owner, np.arange(len(sizes) + 1))  # shards are in the order of sources
    quotas = [apportion(ring[a:b].astype(np.float64), int(n), room[a:b]) for a, b, n in zip(begins, begins[1:], source_blocks, strict=False)]
    per_shard["quota"] = np.minimum(np.concatenate([*quotas, np.zeros(0, np.int64)]) * block, MOST * ring)
    rings = spark.createDataFrame(per_shard.astype({"k": "int32"}), "k int, shard long, ring long, quota long")
    # places on the ring: running sums within a shard, which is small
    on = Window.partitionBy("k", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("place", F.sum("size").over(on) - F.col("size")).join(F.broadcast(rings), ["k", "shard"]).join(F.broadcast(plan.select("k", "source_size", "target")), "k")
    blocks_on = F.greatest(F.ceil(F.col("ring") / F.lit(block)), F.lit(1))
    out = out.withColumn("first", F.least(F.pmod(F.xxhash64(F.lit(seed + 1), "k", "shard"), blocks_on) * block, F.greatest(F.col("ring") - 1, F.lit(0))))
    taken = taken_before(F.col("place") + F.col("size")) - taken_before(F.col("place"))
    return out.withColumn("taken", taken).select("doc_id", "size", "source_size", "target", "taken", "source", "draw", "place", "ring", "first", "quota")


def taken_before(place: Column) -> Column:
    """How many words of the ring before ``place`` the quota takes: whole rounds, and an arc of ``rest`` from ``first`` on, which may go past the end."""
    rounds = F.when(F.col("ring") > 0, F.floor(F.col("quota") / F.greatest(F.col("ring"), F.lit(1)))).otherwise(F.lit(0))
    rest = F.col("quota") - rounds * F.col("ring")
    inside = F.greatest(F.lit(0), F.least(place, F.col("first") + rest) - F.col("first"))
    wrapped = F.greatest(F.lit(0), F.least(place, F.col("first") + rest - F.col("ring")))
    return (rounds * place + inside + wrapped).cast("long")


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each round and stretch of a document that is taken.

    A document whose every word is taken keeps its text unchanged; of one that is taken in part the text is cut before
    the first and after the last word taken. One taken twice stands there twice. A column ``n_chars`` follows the text.
    Documents of no words take no part in the mix and stay.
    """
    rounds = F.when(F.col("ring") > 0, F.floor(F.col("quota") / F.greatest(F.col("ring"), F.lit(1)))).otherwise(F.lit(0))
    rest = F.col("quota") - rounds * F.col("ring")

    def arc(begin: Column, end: Column) -> Column:
        lo, hi = F.greatest(begin, F.col("place")), F.least(end, F.col("place") + F.col("size"))
        return F.when(hi > lo, F.struct((lo - F.col("place")).alias("lo"), (hi - F.col("place")).alias("hi")))

    whole = F.struct(F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"))
    arcs = F.concat(F.array_repeat(whole, F.when(F.col("size") == 0, 1).otherwise(rounds).cast("int")), F.array_compact(F.array(arc(F.col("first"), F.col("first") + rest), arc(F.lit(0).cast("long"), F.col("first") + rest - F.col("ring")))))
    # a document finds its arcs by id, source, draw and, among rows alike in these, by number
    alike = ["id", "of", "draw"]

    def keys(source: Column, draw: Column) -> list[Column]:
        return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("of"), draw.alias("draw")]

    ask = mix(docs, block, seed=seed).withColumn("arcs", arcs).select(*keys(F.col("source"), F.col("draw")), "arcs", "place", "size")
    ask = ask.withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy("place"))).drop("place").where(F.size("arcs") > 0)
    own = docs.select(F.struct("*").alias("row"), *keys(F.col("source").cast("string"), _draw(seed)))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy("id")))
    taken = own.join(ask, [*alike, "nth"]).withColumn("arc", F.explode("arcs"))

    @F.arrow_udf(StringType())
    def between(texts: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        return by_slices(_cut_words, pa.string(), texts, lo, hi)

    cut = taken.withColumn("text", between(F.col("row.text"), F.col("arc.lo"), F.when((F.col("arc.lo") > 0) | (F.col("arc.hi") < F.col("size")), F.col("arc.hi"))))
    fields = {f.name: F.col("row")[f.name] for f in docs.schema}
    fields["text"] = F.col("text")
    if "n_chars" in fields:
        fields["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[c.alias(name) for name, c in fields.items()])


def _cut_words(texts: list, lo: list, hi: list) -> list:
    """Each text from its word ``lo`` up to before its word ``hi``; the whole of it if that is null."""
    out = []
    for text, a, b in zip(texts, lo, hi, strict=True):
        if b is not None:
            begin = end = 0
            for k, word in enumerate(_WORD.finditer(text)):
                if k == a:
                    begin = word.start()
                if k == b - 1:
                    end = word.end()
                    break
            text = text[begin:end]
        out.append(text)
    return out

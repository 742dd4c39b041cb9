"""SpotSigs fingerprints with DataFrame functions only.

A signature starts at a common word (or a run of them) and chains the next content words; the set of a text's signatures
is its fingerprint. Sets are compared by Jaccard likeness. In the self-join equal sets are one class; classes are dealt
by the length of their sets and by their rarest signatures, so that only sets which can be alike enough ever meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatecast.llm.common import checkpoint

#: Common words of English, German, French and Spanish (fixed values).
COMMON_BY_LANGUAGE = (
    "the of and to in a is that it for on was be with as by this are at an from or not have has his her they you",
    "der die und das den von zu mit sich auf für ist nicht dem des im ein eine als auch es er sie wir",
    "le la les des et est un une pour pas que du dans qui par sur au avec ce il ne se",
    "el los las de y en por con del una no su para lo más como",
)
COMMON = " ".join(COMMON_BY_LANGUAGE).split()
#: Content words in a chain, and the bytes of text that one bucket of neighbours should hold.
CHAIN, BUCKET_BYTES = 3, 4_000_000
#: Ranges of ids, and parts of one: their bounds are 16 MB at most, for 8 TB of text in buckets of that size.
RANGES, PARTS = 1_000, 2_000
SIMILARITY = 0.8

_JOINT = "\x01"


def with_signatures(df: DataFrame, text: str, name: str, chain: int = CHAIN) -> DataFrame:
    """``df`` and ``name``: the sorted distinct signatures of a text column, as long hashes.

    A text without any has one signature, of the whole of its words, so that short and empty texts compare as well.
    """
    words, units, content = f"_{name}_words", f"_{name}_units", f"_{name}_content"
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    df = df.withColumn(words, plain)
    # common words are glued to what follows them, so a unit is a content word with the common words before it
    glued = F.transform(F.split(words, " "), lambda w: F.when(w.isin(COMMON), F.concat(w, F.lit(_JOINT))).otherwise(F.concat(w, F.lit(" "))))
    df = df.withColumn(units, F.split(F.array_join(glued, ""), " "))
    df = df.withColumn(content, F.transform(units, lambda u: F.substring_index(u, _JOINT, -1)))

    def signature(unit: Column, k: Column) -> Column:
        return F.when(F.instr(unit, _JOINT) > 0, F.xxhash64(unit, *[F.get(F.col(content), k + i) for i in range(1, chain)]))

    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(units, signature))))
    df = df.withColumn(name, found)
    df = df.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(F.array(F.xxhash64(words))))
    return df.drop(units, content, words)


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two signature columns."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def digest(signatures: str) -> Column:
    """A fingerprint's name: 128 bits of its set, as hex digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), signatures)), 16, "0") for k in (0, 1)]))


def _bounds(docs: DataFrame) -> tuple[list[int], int]:
    """Ids that part the rows, in their order, into ranges of like size, of which the last is the greatest id, and into how many parts each should go."""
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("n"), F.max("_id").alias("top")).first()
    if size["top"] is None:
        return [0], 1
    buckets = int(size["n"]) // BUCKET_BYTES + 1
    n = min(RANGES, buckets)
    at = docs.agg(F.percentile_approx("_id", [(k + 1) / n for k in range(n)], max(10_000, 4 * n)).alias("at")).first()["at"]
    return sorted({*at[:-1], size["top"]}), min(PARTS, -(-buckets // n))


def _less(table: Column, ids: str, most: int) -> Column:
    """How many of a sorted table's bounds, ``most`` at most, are less than the id, by halving."""
    steps = [1 << k for k in reversed(range(most.bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when((at + step <= F.size(table)) & (F.get(table, at + step - 1) < F.col(ids)), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` and ``signatures``, ``next_text``, ``next_signatures`` of the next row by descending id.

    After the last comes the first. Null ids go last, equal ids by text. Rows are dealt by ranges of ids and parts of
    these; the first row of each part is also given to the part before it in this order, so no part is larger than
    planned, but for repeats of one id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds, n_parts = _bounds(docs)
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    docs = docs.withColumn("_range", _less(table, "_id", len(bounds)))
    top = F.array(F.get(table, F.col("_range")))
    if n_parts > 1:
        inside = F.percentile_approx("_id", [(k + 1) / n_parts for k in range(n_parts - 1)], max(10_000, 4 * n_parts))
        parts = docs.groupBy("_range").agg(inside.alias("inside")).select("_range", F.array_sort(F.array_distinct(F.concat("inside", top))).alias("_ends"))
        docs = docs.join(F.broadcast(checkpoint(parts)), "_range")  # RANGES rows of PARTS numbers at most
    else:
        docs = docs.withColumn("_ends", top)
    docs = docs.withColumn("_part", _less(F.col("_ends"), "_id", n_parts))
    own = F.struct(F.col("_range").alias("range"), F.col("_part").alias("part"), F.lit(False).alias("guest"))
    beyond = F.col("_part") + 1 == F.size("_ends")
    after = F.struct(F.when(beyond, F.pmod(F.col("_range") + 1, F.lit(len(bounds)))).otherwise(F.col("_range")).alias("range"), F.when(beyond, 0).otherwise(F.col("_part") + 1).alias("part"), F.lit(True).alias("guest"))
    places = F.array_compact(F.array(own, F.when(F.col("_id") == F.get("_ends", F.col("_part")), after)))
    dealt = docs.withColumn("_place", F.explode(places)).select("doc_id", "_id", "text", "_place.range", "_place.part", "_place.guest").repartition("range", "part")
    signed = with_signatures(dealt, "text", "signatures")
    order = Window.partitionBy("range", "part").orderBy("guest", F.col("_id").desc(), "text")
    return signed.withColumns({"next_text": F.lead("text").over(order), "next_signatures": F.lead("signatures").over(order)}).where("not guest").drop("_id", "range", "part", "guest")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The edited text has its last half (rounded down) of code points replaced by the first as many of the next document
    by descending id. A null text is empty; repeated rows each come out and are neighbours; other columns are ignored;
    an empty table gives an empty table. Texts of no words are alike.
    """
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / F.lit(2)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signatures", "next_signatures")
    rows = with_signatures(rows, "edited", "edited_signatures")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest("signatures").alias("fingerprint"),
        digest("edited_signatures").alias("edited_fingerprint"),
        likeness("signatures", "edited_signatures").alias("near_edited"),
        likeness("signatures", "next_signatures").alias("near_next"),
    )


def similar_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates: ``(doc_id, class_id)`` for every row, and ``(a, b, likeness)`` of classes at least so similar.

    A class has the rows of one set and its least id for a name. Of each set, of n signatures, only the
    n - ceil(similarity * n) + 1 rarest are looked up, and only among sets of lengths from similarity * n on, in whose
    length ranges it is dealt; a pair is compared once. Null ids are passed over, repeated rows are in one class, null
    texts are empty, and an empty table gives empty tables.
    """
    signed = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"), "text", "signatures")
    signed = checkpoint(signed.select("doc_id", "signatures", digest("signatures").alias("name")))
    classes = checkpoint(signed.groupBy("name").agg(F.min("doc_id").alias("class_id"), F.first("signatures").alias("signatures")))
    members = signed.select("doc_id", "name").join(classes.select("name", "class_id"), "name").select("doc_id", "class_id")
    rare = classes.select("class_id", F.explode("signatures").alias("signature"))
    often = rare.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    ranked = rare.join(often, "signature").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("n", "signature"))).alias("ranked"))
    size = F.size("ranked")
    prefix = size - F.ceil(size * F.lit(similarity) - F.lit(1e-9)).cast("int") + 1
    looked = ranked.select("class_id", size.alias("size"), F.explode(F.slice("ranked", F.lit(1), prefix)).alias("r")).select("class_id", "size", "r.signature")
    # ranges of lengths grow by 1 / similarity, so a partner is in the own range or the next
    span = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / similarity))) if similarity < 1 else F.col("size")
    left = looked.select(F.col("class_id").alias("a"), F.col("size").alias("size_a"), "signature", F.explode(F.array(span, span + 1)).alias("span"))
    right = looked.select(F.col("class_id").alias("b"), F.col("size").alias("size_b"), "signature", span.alias("span"))
    fits = (F.col("size_a") <= F.col("size_b")) & (F.col("size_a") >= F.col("size_b") * similarity - 1e-9) & ((F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["signature", "span"]).where(fits).select("a", "b").distinct()
    sets = classes.select("class_id", "signatures")
    both = pairs.join(sets.withColumnsRenamed({"class_id": "a", "signatures": "x"}), "a").join(sets.withColumnsRenamed({"class_id": "b", "signatures": "y"}), "b")
    near = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness("x", "y").alias("likeness")).where(F.col("likeness") >= similarity)
    return members, near


def links(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, class_id, n_links)`` for every row with an id: the least id whose set of signatures is the same, and the number of other sets at least so similar."""
    members, near = similar_classes(docs, similarity)
    ends = near.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

"""A Merkle manifest of a dataset: every row's place, proof and check, without a global sort.

``radix_ranks`` gives each row its exact rank in its group. Histograms of the leading hexadecimal digits of the key, taken
level by level, say how many rows come before a bucket of keys; within a bucket, which is small, rows are numbered. A
bucket that is still crowded (clustered or repeated ids) is parted again by its next digits, skipping those that all its
keys share.

Ranks in base ``fanout`` then key the nodes of a trie: a rank without its last digit is its parent, so all ranks with one
prefix meet in one node. Nodes are reduced a few digits at a time, in blocks of at most BLOCK nodes, upwards for the
roots and downwards for the siblings. What crosses the network is digests, never texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatecast.llm.common import checkpoint, held_out

#: Rows of a bucket that are numbered by one window, and nodes that are reduced at once.
BUCKET, BLOCK = 4096, 1024
#: Hexadecimal digits looked at in one go (they fit into a long), and those of one level of a histogram.
SPAN, LEVEL = 15, 3
#: Crowded buckets that are broadcast: some ten megabytes.
FEW = 50_000


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value; numbers are written decimally."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def ordered_long(value: Column) -> Column:
    """Hexadecimal digits that sort as the numbers do, a null first."""
    digits = F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), digits))


def ordered_text(value: Column) -> Column:
    """Hexadecimal digits that sort as the UTF-8 bytes do, a null first."""
    return F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.hex(F.encode(value, "utf-8"))))


def _depths(rows: DataFrame, limit: int) -> DataFrame:
    """``(g, at, shared, size)`` of each bucket of ``rows(g, key, at)`` with over ``limit`` rows: the digits to part it by.

    Of the digits after ``at`` the ``shared`` ones, which all its rows have, are passed over; then follow as many as
    would leave ``limit`` rows if they were all in use, and one more.
    """
    ahead = F.rpad(F.substr("key", F.length("at") + 1, F.lit(SPAN)), SPAN, "0")
    value = F.conv(ahead, 16, 10).cast("long")
    found = rows.groupBy("g", "at").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).where(F.col("n") > limit)
    differ = F.col("low").bitwiseXOR(F.col("high"))
    shared = F.when(differ == 0, F.lit(SPAN)).otherwise(SPAN - F.length(F.hex(differ)))
    wanted = F.when(differ == 0, F.lit(0)).otherwise(F.ceil(F.log2(F.col("n") / limit) / 4).cast("int") + 1)
    return found.select("g", "at", shared.alias("shared"), (F.length("at") + shared + wanted).alias("size"), wanted.alias("wanted"))


def _before(children: DataFrame, deepest: int) -> DataFrame:
    """``children(g, at, child, shared, n, base, total)`` with ``base`` raised by the rows of the lesser children of its parent.

    These are added up level by level, among at most 16 ** LEVEL values of the digits that follow one prefix.
    """
    held = children.withColumn("tail", F.substr("child", F.length("at") + F.col("shared") + 1, F.lit(1 << 20)))
    for level in range(-(-deepest // LEVEL)):
        upper, lower = (F.substring("tail", 1, LEVEL * k) for k in (level, level + 1))
        here = held.groupBy("g", "at", upper.alias("upper"), lower.alias("lower")).agg(F.sum("n").alias("here"))
        earlier = Window.partitionBy("g", "at", "upper").orderBy("lower").rowsBetween(Window.unboundedPreceding, -1)
        sums = here.select("g", "at", "lower", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("less"))
        held = held.withColumn("lower", lower).join(sums, ["g", "at", "lower"]).withColumn("base", F.col("base") + F.col("less")).drop("lower", "less")
    return held


def radix_ranks(rows: DataFrame, limit: int = BUCKET) -> DataFrame:
    """``rows(g, key, ...)`` with ``rank``, from 0, in the order of ``key`` within ``g``, and ``total``, the group's rows.

    ``g`` is not null, and ``key``, hexadecimal digits, is unique within it. ``rows`` should have been written before, as
    they are read several times. The crowded buckets, of which there are ``1 / limit`` of the rows at most, are broadcast
    while they are few.
    """
    held = waiting = rows.withColumn("at", F.lit(""))
    done = checkpoint(rows.groupBy("g").agg(F.count("*").alias("total")).select("g", F.lit("").alias("at"), F.lit(0).cast("long").alias("base"), "total"))
    while True:
        crowded = checkpoint(_depths(waiting, limit))
        count, deepest = crowded.agg(F.count("*"), F.max("wanted")).first()
        if not count:
            break
        parents = crowded.join(done, ["g", "at"]).select("g", "at", "shared", "size", "base", "total")
        sizes = crowded.select("g", "at", "size")
        sizes = F.broadcast(sizes) if count <= FEW else sizes
        parted = F.expr("substring(key, 1, size)")
        waiting = waiting.join(sizes, ["g", "at"])
        children = waiting.groupBy("g", "at", parted.alias("child")).agg(F.count("*").alias("n")).join(parents, ["g", "at"])
        placed = _before(children, deepest).select("g", F.col("child").alias("at"), "base", "total")
        done = checkpoint(done.join(crowded.select("g", "at"), ["g", "at"], "left_anti").unionByName(placed))
        waiting = waiting.select("g", "key", parted.alias("at"))
        held = held.join(sizes, ["g", "at"], "left").withColumn("at", F.when(F.col("size").isNull(), F.col("at")).otherwise(parted)).drop("size")
    within = Window.partitionBy("g", "at").orderBy("key")
    numbered = held.withColumn("nth", F.row_number().over(within) - 1).join(done, ["g", "at"])
    return numbered.withColumn("rank", F.col("nth") + F.col("base")).drop("at", "base", "nth")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def heights(nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """The nodes and the levels above them: every ``fanout`` consecutive ones, the last run being shorter, become one."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def siblings(built: list[list[str]], fanout: int, place: int) -> list[tuple[str, str]]:
    """For each level what stands left and right of the node of ``place`` in its run."""
    out = []
    for level in built[:-1]:
        first = place - place % fanout
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + fanout])))
        place //= fanout
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest([left, node, right])
    return node


def levels_of(total: int, fanout: int) -> int:
    """Levels from ``total`` nodes to one."""
    levels = 0
    while total > 1:
        total, levels = -(-total // fanout), levels + 1
    return levels


@dataclass(frozen=True)
class Shape:
    """How many nodes make one, and how many levels are built at once: what tasks need to know of a trie."""

    fanout: int
    steps: int

    @property
    def width(self) -> int:
        return self.fanout**self.steps

    def levels(self, total: int) -> int:
        return min(self.steps, levels_of(total, self.fanout))

    def built(self, table: pa.Table) -> list[list[str]]:
        """The levels over a block of nodes that are sorted by place."""
        return heights(table["node"].to_pylist(), self.fanout, self.levels(table["total"][0].as_py()))

    def paths(self, built: list[list[str]], above: list[dict]) -> list[list[tuple[str, str]]]:
        rest = [(step["left"], step["right"]) for step in above]
        return [siblings(built, self.fanout, place) + rest for place in range(len(built[0]))]


_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PATHS = "g string, place long, path array<struct<left string, right string>>"


class Trie:
    """The nodes of all groups of ``leaves(g, place, node, total)``, a few levels of ``fanout`` at a time.

    ``place`` counts from 0 to ``total`` less one without a gap. ``roots`` are ``(g, node)``; of a group of one node it
    is that node itself. A tier, which spans as many levels as keep a block of it within ``block`` nodes, is written
    once, and the one above has a row a block.
    """

    def __init__(self, leaves: DataFrame, fanout: int = 2, block: int = BLOCK) -> None:
        self.shape = Shape(fanout, max(1, levels_of(block + 1, fanout) - 1))
        most = leaves.agg(F.max("total")).first()[0] or 0
        self.tiers = [leaves.select("g", "place", "node", "total")]
        while most > 1:
            self.tiers.append(checkpoint(self._reduced(self.tiers[-1])))
            most = -(-most // self.shape.width)
        self.roots = self.tiers[-1].select("g", "node")

    def block(self) -> Column:
        return F.expr(f"place div {self.shape.width}").alias("block")

    def _reduced(self, nodes: DataFrame) -> DataFrame:
        shape = self.shape

        def run(key: tuple, table: pa.Table) -> pa.Table:
            total = -(-table["total"][0].as_py() // shape.width)
            return pa.table({"g": [key[0].as_py()], "place": [key[1].as_py()], "node": shape.built(table.sort_by("place"))[-1], "total": [total]})

        return nodes.groupBy("g", self.block()).applyInArrow(run, "g string, place long, node string, total long")

    def paths(self, above: DataFrame) -> DataFrame:
        """The paths ``(g, place, path)`` of the blocks of leaves, given those of the roots, ``above(g, path)``."""
        known = above.select("g", F.lit(0).cast("long").alias("place"), "path")
        for nodes in reversed(self.tiers[1:]):
            known = checkpoint(self.downward(nodes, known))
        return known

    def downward(self, nodes: DataFrame, known: DataFrame) -> DataFrame:
        """The paths of a tier's ``nodes``, given those of its blocks."""
        shape = self.shape

        def run(table: pa.Table, upper: pa.Table) -> pa.Table:
            table = table.sort_by("place")
            paths = shape.paths(shape.built(table), upper["path"][0].as_py()) if table.num_rows else []
            steps = pa.array([[{"left": a, "right": b} for a, b in path] for path in paths], _PATH)
            return pa.table([table["g"], table["place"], steps], ["g", "place", "path"])

        return nodes.groupBy("g", self.block()).cogroup(known.groupBy("g", F.col("place").alias("block"))).applyInArrow(run, _PATHS)


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", fanout: int = 2, block: int = BLOCK, bucket: int = BUCKET, changed: Column | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified)`` for every row of ``docs``.

    A leaf is the hash of the row's ``fields``. Each group's leaves, ascending by ``doc_id``, are reduced to its subroot,
    and the subroots, by the bytes of the group's name, to the root, every ``fanout`` nodes at a time. ``proof`` holds
    the siblings on the way up. ``folded_root`` is what ``changed`` (a leaf; null where it is the row's own), and those
    siblings lead to; ``verified`` says whether that is the root.

    A null group and a null id come first. Rows of one id stand in the order of their leaves; equal rows each have a place
    and a proof of their own. Texts may be null, empty or long: they are hashed where they are read. Further columns are
    ignored. An empty table gives an empty table.
    """
    row_id, name = F.col("doc_id").cast("long"), F.col(group).cast("string")
    changed = F.lit(None).cast("string") if changed is None else changed
    made = docs.select(row_id.alias("doc_id"), ordered_text(name).alias("g"), leaf_of(*map(F.col, fields)).alias("node"), changed.alias("changed"))
    made = checkpoint(made.withColumn("row", F.monotonically_increasing_id()))
    keyed = made.select("*", F.concat(ordered_long(F.col("doc_id")), F.col("node"), ordered_long(F.col("row"))).alias("key"))
    leaves = checkpoint(radix_ranks(keyed, bucket).select("g", F.col("rank").alias("place"), "node", "total", "doc_id", "changed"))
    trie = Trie(leaves, fanout, block)
    tops = checkpoint(radix_ranks(checkpoint(trie.roots.select(F.lit("").alias("g"), F.col("g").alias("key"), "node")), bucket))
    crown = Trie(tops.select("g", F.col("rank").alias("place"), "node", "total"), fanout, block)
    root = crown.roots.select("node").first()
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    below = crown.downward(crown.tiers[0], crown.paths(crown.roots.select("g", nothing.alias("path")))).select("place", "path")
    named = tops.select(F.col("key").alias("g"), F.col("rank").alias("place"), F.col("node").alias("subroot"), F.lit(root[0] if root else "").alias("root"))
    above = checkpoint(named.join(below, "place").drop("place"))
    known = trie.paths(above).join(above.select("g", "subroot", "root"), "g")
    shape = trie.shape

    def prove(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        nodes, changed = table["node"].to_pylist(), table["changed"].to_pylist()
        paths = shape.paths(shape.built(table), upper["path"][0].as_py()) if nodes else []
        proofs = ["".join(left + right for left, right in path) for path in paths]
        folded = [fold(node if new is None else new, path) for node, new, path in zip(nodes, changed, paths, strict=True)]
        subroot, root = (upper[c].to_pylist() * len(nodes) for c in ("subroot", "root"))
        texts = [pa.array(values, pa.string()) for values in (nodes, subroot, root, proofs, folded)]
        return pa.table([table["doc_id"], *texts], ["doc_id", "leaf", "subroot", "root", "proof", "folded_root"])

    held = leaves.groupBy("g", trie.block()).cogroup(known.groupBy("g", F.col("place").alias("block")))
    out = held.applyInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", "root", "proof", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered() -> Column:
    """The leaf with one character more in ``n_chars``, for the ids whose crc32 7 divides (a null id counts as the empty text)."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    return F.when(held_out("doc_id", 7, 0) & F.col("n_chars").isNotNull(), leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))


def _sql_field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR) END"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_SQL_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
    4294967295::BIGINT), 4294967295)"""

#: Level by level in recursive queries; steps to the root are a letter for the side of the sibling, and the sibling.
ORACLE = f"""
WITH RECURSIVE made AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
    CASE WHEN ({_SQL_CRC}) % 7 = 0 THEN {_sql_leaf("(n_chars + 1)")} END AS changed FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS total FROM made),
nodes AS (
  SELECT lang, 0 AS level, place, leaf AS node, total FROM leaves
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(total) + 1) // 2
  FROM nodes WHERE total > 1 GROUP BY lang, level, place // 2),
subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM nodes WHERE total = 1),
crown AS (
  SELECT 0 AS level, place, subroot AS node, total FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(total) + 1) // 2
  FROM crown WHERE total > 1 GROUP BY level, place // 2),
lower_steps AS (
  SELECT l.lang, l.place, list(CASE WHEN s.node IS NULL THEN '-' WHEN s.place % 2 = 0 THEN 'l' || s.node ELSE 'r' || s.node END ORDER BY n.level) AS steps
  FROM leaves l JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.total > 1 AND n.place = l.place >> n.level
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM n.lang AND s.level = n.level AND s.place = xor(n.place, 1)
  GROUP BY l.lang, l.place),
upper_steps AS (
  SELECT r.lang, list(CASE WHEN s.node IS NULL THEN '-' WHEN s.place % 2 = 0 THEN 'l' || s.node ELSE 'r' || s.node END ORDER BY n.level) AS steps
  FROM subroots r JOIN crown n ON n.total > 1 AND n.place = r.place >> n.level LEFT JOIN crown s ON s.level = n.level AND s.place = xor(n.place, 1)
  GROUP BY r.lang),
proved AS (
  SELECT l.doc_id, l.leaf, l.changed, r.subroot, (SELECT node FROM crown WHERE total = 1) AS root,
    list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN lower_steps a ON a.lang IS NOT DISTINCT FROM l.lang AND a.place = l.place LEFT JOIN upper_steps b ON b.lang IS NOT DISTINCT FROM l.lang),
folded AS (
  SELECT *, list_reduce(steps, lambda node, step: sha256(CASE step[1] WHEN 'l' THEN step[2:] || node WHEN 'r' THEN node || step[2:] ELSE node END), coalesce(changed, leaf)) AS folded_root
  FROM proved)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""

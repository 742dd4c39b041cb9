"""Repeated byte strings found by suffix sorting, and their removal.

Every string of ``length`` bytes has an anchor: the position of the least hash among its grams of ``gram`` bytes. Equal
strings have equal anchors at equal distances, so strings are compared only where anchors' grams agree. All strings of
one anchor form one stretch of text (its form). All forms of a gram meet in one task, one that occurs more than once by
its first and its last place, and their suffixes are put in order by two-stage sorting: suffixes that are smaller than
their successors are sorted directly, the rest is induced by scanning the buckets of first bytes; then adjacent common
prefixes show which strings occur twice. What is found for a form holds at all its places. A gram with more than ``busy`` such places (a passage that
very many documents share) is dealt out string by string instead, by 128-bit hashes, whose counts combine before the
shuffle, so that no task gathers such a group. Where all that a gram stands in is one form, there is nothing to put in
order: it occurs more than once or not, and its first and last place are held against each other by SHA-256.

Several lengths can be searched at once with the same grams: each has its own anchors and forms, and the anchors of longer
strings are among those of shorter ones, whose grams alone need to be counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from slatecast.llm.common import by_slices, checkpoint, map_batches, mix64, release, segments, slices, utf8

LENGTH, GRAM = 400, 250
#: Bytes of a string by which repeated passages of over fifty words are found, and of a gram for it; such a passage may have
#: less than 300 bytes.
PASSAGE, PASSAGE_GRAM = 256, 128
#: So many places of a gram's forms are sorted together: about a MB of text, as much as one sort takes.
BUSY = 2048
#: Bytes of text handled at once; longer texts are cut into overlapping pieces. Below 2**20, see ``anchors``.
PIECE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes of any stretch of a byte array, modulo 2**64."""

    def __init__(self, seed: int, n: int) -> None:
        rng = np.random.default_rng(seed)
        base = int(rng.integers(1 << 62, 1 << 63)) | 5
        self.letters = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=out[1:])
        return out

    def stretch(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((prefix[b] - prefix[a]) * self.down[a])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by running minima from both sides of blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """The anchors of a batch of texts, for strings of each length; each knows the run of strings that it stands for."""

    def __init__(self, lengths: int | tuple[int, ...], gram: int) -> None:
        self.lengths, self.gram = (lengths,) if isinstance(lengths, int) else lengths, gram
        self.least, self.most = min(self.lengths), max(self.lengths)
        self.one, self.two = Rolling(11, PIECE + 2 * self.most), Rolling(12, PIECE + 2 * self.most)

    def pieces(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Joined bytes, and for each part of them: its text's number, offset there, and length."""
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            for at in range(0, max(len(text) - self.least + 1, 0), PIECE):
                part = text[at : at + PIECE + self.most - 1]
                if held and size + len(part) > PIECE + self.most:
                    yield self._join(held)
                    held, size = [], 0
                held.append((k, at, part))
                size += len(part)
        if held:
            yield self._join(held)

    @staticmethod
    def _join(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        return data, *(np.array(x, np.int64) for x in zip(*((k, at, len(p)) for k, at, p in held), strict=True))

    def _anchors(self, data: np.ndarray, length: int, grams: np.ndarray, part: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first and the last string of each run with one anchor, and that anchor, as places of ``data``."""
        low = np.uint64(0xFFFFF)  # ties go to the position further left
        at = np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_least((grams & ~low) | at, length - self.gram + 1) & low).astype(np.int64)
        part = part[: len(anchor)]
        own = np.arange(len(anchor)) - base[part]
        whole = (own + length <= size[part]) & (own < PIECE)  # what starts further on is the next piece's
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
        first = np.flatnonzero(new & whole)
        # within a part the whole strings come first, so a run ends before the next run or the first string cut off
        ends = np.flatnonzero(whole & np.concatenate([new[1:] | ~whole[1:], [True]]))
        return first, ends, anchor[first]

    def _grams(self, data: np.ndarray) -> np.ndarray:
        at = np.arange(len(data) - self.gram + 1)
        return self.one.stretch(self.one.prefix(data), at, at + self.gram)

    def grams(self, texts: list[bytes]) -> np.ndarray:
        """The anchors' grams for strings of the least length, as often as they are anchors."""
        out = [np.zeros(0, np.uint64)]
        for data, _, _, size in self.pieces(texts):
            base, part = segments(size)
            grams = self._grams(data)
            out.append(grams[self._anchors(data, self.least, grams, part, base, size)[2]])
        return np.concatenate(out)

    def find(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """``text, start, before, more``: the text's number, the first string's start, the anchor's distance from it and
        the number of strings beyond the first; ``gram, form``: hashes of the anchor's gram and of all those strings;
        ``length``: that of the strings."""
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "start", "before", "more", "gram", "form", "length")}
        for data, number, offset, size in self.pieces(texts):
            base, part = segments(size)
            grams, two = self._grams(data), self.two.prefix(data)
            for length in self.lengths:
                if len(data) < length:
                    continue
                first, ends, q = self._anchors(data, length, grams, part, base, size)
                p = part[first]
                out["text"].append(number[p])
                out["start"].append(first - base[p] + offset[p])
                out["before"].append(q - first)
                out["more"].append(ends - first)
                out["gram"].append(grams[q])
                shape = ((q - first) * 4096 + (ends - first)).astype(np.uint64)
                out["form"].append(mix64(self.two.stretch(two, first, ends + length) ^ mix64(shape)))
                out["length"].append(np.full(len(q), length))
        return {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("gram", "form") else np.int64) for k, v in out.items()}


def two_stage_order(data: np.ndarray, base: np.ndarray, count: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that start at the first ``count`` places of each part, in the order of their first ``depth`` bytes.

    Part k lies from ``base[k]`` to ``end[k]`` and has ``depth`` bytes from each of those places.
    """
    n = len(data)
    keys = big_endian_words(data)
    # is a suffix smaller than its successor? the next pair of unequal neighbours tells; a run up to a part's end counts as smaller
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[end - 1] = 1
    turns = np.flatnonzero(step)
    smaller = step[turns[np.searchsorted(turns, np.arange(n))]] > 0
    # a part's suffixes, and after them those up to the next that is sorted directly, from which they are induced
    rising = np.flatnonzero(smaller)
    last = base + count - 1
    tail = rising[np.searchsorted(rising, last)]
    starts, part = segments(tail - base + 1)
    own = base[part] + np.arange(len(part)) - starts[part]
    limit = np.minimum(end[part], own + depth)
    direct = smaller[own]
    ordered = sort_directly(data, keys, own[direct], limit[direct])
    member, falling = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    member[own] = True
    member[base] = False  # has no predecessor in its part
    falling[own[~direct]] = True
    first_byte = data[own]
    sizes = np.bincount(first_byte, minlength=256)
    sizes_direct = np.bincount(first_byte[direct], minlength=256)
    left = np.cumsum(sizes) - sizes
    head = left.copy()
    out = np.empty(len(own), np.int64)
    cut = np.cumsum(sizes_direct) - sizes_direct
    for c in np.flatnonzero(sizes):
        begin = left[c] + sizes[c] - sizes_direct[c]
        out[begin : left[c] + sizes[c]] = ordered[cut[c] : cut[c] + sizes_direct[c]]
        seen = left[c]
        while True:  # the induced front grows while it is scanned, by runs of its own byte
            stop = head[c] if seen < head[c] else left[c] + sizes[c]
            done = seen >= head[c]
            batch = out[(begin if done else seen) : stop]
            batch = batch[member[batch]] - 1
            batch = batch[falling[batch]]
            seen = max(seen, head[c])
            letters = data[batch]
            by = np.argsort(letters, kind="stable")
            letters, batch = letters[by], batch[by]
            for letter, at, size in zip(*np.unique(letters, return_index=True, return_counts=True), strict=True):
                out[head[letter] : head[letter] + size] = batch[at : at + size]
                head[letter] += size
            if done:
                break
    wanted = np.zeros(n + 1, bool)
    starts, part = segments(count)
    wanted[base[part] + np.arange(len(part)) - starts[part]] = True
    return out[wanted[out]]


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def sort_directly(data: np.ndarray, keys: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """``at`` ordered by the bytes from each place up to its limit, eight at a time; only ties go on.

    A group of ties that hash alike over all their bytes is equal and needs no more looks.
    """
    rolling = Rolling(13, len(data) + 1)
    whole = rolling.stretch(rolling.prefix(data), at, limit)
    order = np.arange(len(at))
    live, group, d = order, np.zeros(len(at), np.int64), 0
    place = np.arange(len(at))  # slots of the result that the live ones share out among themselves, group by group
    while len(live):
        p = at[live] + d
        rest = limit[live] - p
        k = keys[np.minimum(p, len(data) - 1)]
        short = rest < 8
        shift = (8 * (8 - np.clip(rest[short], 1, 8))).astype(np.uint64)
        k[short] = np.where(rest[short] <= 0, np.uint64(0), (k[short] >> shift) << shift)
        by = np.lexsort((k, group)) if d else np.argsort(k)
        live, k, group = live[by], k[by], group[by]
        order[place] = live
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (group[1:] != group[:-1])])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(live)))
        h = whole[live]
        open_group = (sizes > 1) & (np.minimum.reduceat(h, heads) != np.maximum.reduceat(h, heads))
        open_group &= np.maximum.reduceat(limit[live] - at[live], heads) > d + 8
        stay = np.repeat(open_group, sizes)
        group = np.cumsum(new)[stay]
        live, place = live[stay], place[stay]
        d += 8
    return at[order]


def twice_seen(data: np.ndarray, base: np.ndarray, count: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """For each place of ``data``: does a wanted suffix start there whose first ``depth`` bytes start another, too?"""
    order = two_stage_order(data, base, count, end, depth)
    keys = big_endian_words(data)
    alive = np.arange(len(order) - 1)
    for d in range(0, depth, 8):  # common prefixes of neighbours, as far as they matter
        d = min(d, depth - 8)
        alive = alive[keys[order[alive] + d] == keys[order[alive + 1] + d]]
    out = np.zeros(len(data), bool)
    out[order[alive]] = True
    out[order[alive + 1]] = True
    return out


def _runs(flags: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of flags within one part."""
    edge = part[1:] != part[:-1]
    first = np.flatnonzero(flags & np.concatenate([[True], ~flags[:-1] | edge]))
    last = np.flatnonzero(flags & np.concatenate([~flags[1:] | edge, [True]]))
    return first, last


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row's key: its id and a hash of its text; rows that share both are the same text, so share all results."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(utf8()).alias("k2"), "doc_id", utf8())


def _anchor_rows(keyed: DataFrame, lengths: tuple[int, ...], gram: int) -> DataFrame:
    """One row for each anchor: the text's key, its strings' place (start, distance and number packed), gram, form and length."""

    def make():
        anchors = Anchors(lengths, gram)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = anchors.find(batch["text"].to_pylist())
            pick = pa.array(found["text"])
            place = (found["start"] << 24) | (found["before"] << 12) | found["more"]
            columns = [batch["k1"].take(pick), batch["k2"].take(pick), pa.array(place), pa.array(found["gram"].view(np.int64)), pa.array(found["form"].view(np.int64)), pa.array(found["length"].astype(np.int32))]
            return pa.record_batch(columns, ["k1", "k2", "place", "gram", "form", "length"])

        return step

    return map_batches(keyed.select("k1", "k2", "text"), "k1 long, k2 long, place long, gram long, form long, length int", make)


def _gram_rows(keyed: DataFrame, lengths: tuple[int, ...], gram: int) -> DataFrame:
    """Grams and how often they are anchors of strings of the least length, combined within each batch."""

    def make():
        anchors = Anchors(lengths, gram)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            grams, n = np.unique(anchors.grams(batch["text"].to_pylist()), return_counts=True)
            return pa.record_batch([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int32))], ["gram", "n"]) if len(n) else None

        return step

    return map_batches(keyed.select("text"), "gram long, n int", make)


#: Spans found in a form: relative to its start, with the form's place, which is its only one if ``once``.
_OWN = ("k1", "k2", "place", "gram", "form", "length", "once")
_OWN_TYPES = "k1 long, k2 long, place long, gram long, form long, length int, once boolean"
#: A form, by which its places are told from those of others.
_FORM = ("gram", "form", "length")


def _sorted_spans(forms: DataFrame) -> DataFrame:
    """Spans of strings that occur twice among the forms of a gram and length, for each form's first place.

    ``forms(k1, k2, place, gram, form, length, once, first, bytes)`` is dealt by gram and length, so a task orders all forms of
    such a pair, a few MB at a time and never a pair in two parts. A form's last place takes part, but its spans are those
    of the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (part for whole in batches for part in slices(whole)):
            held.append(batch)
            if sum(x.nbytes for x in held) > 4 << 20:
                table = pa.Table.from_batches(held)
                cut = int(edges(table)[-2])  # rows come sorted by length and gram; the last pair may go on
                if cut:
                    yield from solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))
        held = []
        release()

    def edges(table: pa.Table) -> np.ndarray:
        grams, lengths = table["gram"].to_numpy(), table["length"].to_numpy()
        return np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (lengths[1:] != lengths[:-1]), [True]]))

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = table["bytes"].to_pylist()
        lengths, leads = table["length"].to_numpy(), table["first"].to_numpy()
        whole = {c: table[c].combine_chunks() for c in _OWN}
        bounds = edges(table)
        at = 0
        while at < len(bounds) - 1:
            size, to, length = 0, at, int(lengths[bounds[at]])
            while to < len(bounds) - 1 and lengths[bounds[to]] == length and (size < 1 << 19 or to == at):
                size += sum(map(len, parts[bounds[to] : bounds[to + 1]]))
                to += 1
            rows = slice(bounds[at], bounds[to])
            at = to
            data = np.frombuffer(b"".join(parts[rows]), np.uint8)
            sizes = np.fromiter(map(len, parts[rows]), np.int64)
            base, part = segments(sizes)
            flags = twice_seen(data, base, sizes - length + 1, base + sizes, length)
            flags &= leads[rows][part]
            first, last = _runs(flags, part)
            owner = part[first]
            lo = first - base[owner]
            mine = pa.array(owner + rows.start)
            yield pa.record_batch([*(whole[c].take(mine) for c in _OWN), pa.array(lo), pa.array(lo + last - first + length)], [*_OWN, "lo", "hi"])

    return forms.mapInArrow(run, f"{_OWN_TYPES}, lo long, hi long")


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM, busy: int = BUSY) -> tuple[DataFrame, DataFrame]:
    """The keyed texts, and ``(k1, k2, length, lo, hi)``: stretches of bytes, all of whose strings of that length also start elsewhere."""
    if any(not 8 <= gram <= x or x - gram > 4000 or x % 8 for x in lengths):
        raise ValueError("gram must be from 8 to length, at most 4000 less than it, and length a multiple of 8")
    keyed = _keyed(docs)
    grams = _gram_rows(keyed, lengths, gram).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    # written first: a join whose both sides are dealt anew lets Spark split the rows of a very frequent gram
    rows = checkpoint(_anchor_rows(keyed, lengths, gram).join(checkpoint(grams.select("gram")), "gram"))
    # one row for each form, by the first and the last of its places
    place = F.struct("k1", "k2", "place")
    forms = checkpoint(rows.groupBy(*_FORM).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"), F.max(place).alias("other")))
    # a gram's only form is compared with itself, if it has more than one place; many forms go string by string
    crowds = checkpoint(forms.groupBy("gram", "length").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.least(F.col("n"), F.lit(2))).alias("places")).where("places > 1"))
    alone = F.col("kinds") == 1
    single = F.col("n") == 1
    ends = F.filter(F.array(F.struct("at", F.lit(True).alias("first")), F.struct(F.when(~single, F.col("other")).alias("at"), F.lit(False).alias("first"))), lambda x: x["at"].isNotNull())
    placed = forms.join(crowds, ["gram", "length"]).select(*_FORM, single.alias("once"), alone.alias("alone"), (~alone & (F.col("places") > busy)).alias("busy"), F.explode(ends).alias("end"))
    wanted = placed.groupBy(F.col("end.at.k1").alias("k1"), F.col("end.at.k2").alias("k2")).agg(F.collect_list(F.struct("end.at.place", *_FORM, "once", "alone", "busy", "end.first")).alias("forms"))
    texts = keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])  # rows that repeat are cut once
    cut = checkpoint(_cut(texts))
    few = cut.where("not busy and not alone").drop("busy", "alone").repartition("gram", "length").sortWithinPartitions("length", "gram")
    strings = _strings(cut.where("busy").drop("busy", "alone"), max(lengths))
    twice = strings.groupBy("length", "one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("length", "one", "two")
    again = strings.where("first").join(twice, ["length", "one", "two"], "left_semi").select(*_OWN, "lo", (F.col("lo") + F.col("length")).alias("hi"))
    equal = cut.where("alone").groupBy(*_FORM).agg(F.min("place").alias("place"), (F.min("bytes") == F.max("bytes")).alias("same")).where("same")
    copies = equal.select(*_FORM, F.lit(0).cast("long").alias("lo"), (F.col("place").bitwiseAND(4095) + F.col("length")).alias("hi"))
    found = checkpoint(_sorted_spans(few).unionByName(again))
    start = F.shiftright("place", 24)
    span = ["k1", "k2", "length", (start + F.col("lo")).alias("lo"), (start + F.col("hi")).alias("hi")]
    everywhere = rows.join(found.where("not once").select(*_FORM, "lo", "hi").unionByName(copies), list(_FORM))
    return keyed, found.where("once").select(*span).unionByName(everywhere.select(*span))


def _cut(texts: DataFrame) -> DataFrame:
    """The bytes of each wanted form, or their SHA-256 if it is its gram's only one."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            # as arrays throughout: objects for each form would leave the worker's memory in pieces
            forms = batch["forms"]
            row = forms.value_parent_indices()
            each = dict(zip((f.name for f in forms.type.value_type), forms.flatten().flatten(), strict=True))
            place = each["place"].to_numpy()
            sizes = (place & 4095) + each["length"].to_numpy()
            alone = each["alone"].to_numpy(zero_copy_only=False)
            texts = batch["text"]
            where = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts)].astype(np.int64)
            source = where[row.to_numpy()] + (place >> 24)
            raw = memoryview(texts.buffers()[2])
            data = b"".join(hashlib.sha256(raw[at:to]).digest() if brief else raw[at:to] for at, to, brief in zip(source.tolist(), (source + sizes).tolist(), alone.tolist(), strict=True))
            ends = np.concatenate([[0], np.cumsum(np.where(alone, hashlib.sha256().digest_size, sizes))]).astype(np.int32)
            cut = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            return pa.record_batch([batch["k1"].take(row), batch["k2"].take(row), *(each[c] for c in (*_OWN[2:], "alone", "busy", "first")), cut], [*_OWN, "alone", "busy", "first", "bytes"])

        return step

    return map_batches(texts, f"{_OWN_TYPES}, alone boolean, busy boolean, first boolean, bytes binary", make)


def _strings(forms: DataFrame, longest: int) -> DataFrame:
    """Each string of the forms by two hashes, with its place in the form."""

    def make():
        one, two = Rolling(21, PIECE + 2 * longest), Rolling(22, PIECE + 2 * longest)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts, lengths = batch["bytes"].to_pylist(), batch["length"].to_numpy().astype(np.int64)
            out: list[list[np.ndarray]] = [[], [], [], []]
            for at in range(0, len(parts), 256):
                some = parts[at : at + 256]
                data = np.frombuffer(b"".join(some), np.uint8)
                sizes = np.fromiter(map(len, some), np.int64)
                base, _ = segments(sizes)
                length = lengths[at : at + 256]
                starts, part = segments(sizes - length + 1)
                rank = np.arange(len(part)) - starts[part]
                p = base[part] + rank
                length = length[part]
                for k, x in enumerate((one.stretch(one.prefix(data), p, p + length), two.stretch(two.prefix(data), p, p + length), part + at, rank)):
                    out[k].append(x)
            a, b, part, rank = (np.concatenate(x) for x in out[:4])
            pick = pa.array(part)
            return pa.record_batch([*(batch[c].take(pick) for c in (*_OWN, "first")), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(rank)], [*_OWN, "first", "one", "two", "lo"])

        return step

    return map_batches(forms, f"{_OWN_TYPES}, first boolean, one long, two long, lo long", make)


def kept_pieces(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int, int]:
    """What lies outside the union of ``spans``, and how many bytes and maximal runs lie inside."""
    pieces, at, removed, runs = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(spans):
        if lo > end:
            runs += 1
            pieces.append(text[at:lo])
        removed += max(0, hi - max(lo, end))
        end = max(end, hi)
        at = end
    pieces.append(text[max(at, 0) :])
    return pieces, removed, runs


def _readable(pieces: list[bytes]) -> str:
    """Pieces of a text, less the characters that a cut went through."""
    return "".join(p.decode("utf-8", "ignore") for p in pieces)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, busy: int = BUSY, passage: int | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, text)`` for every row of ``docs(doc_id, text)``.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in this text or another. Strings are
    judged on the input. Null texts are empty, texts under ``length`` bytes stay whole, repeated rows are repeats of
    each other (so from ``length`` bytes on nothing of them stays), other columns are ignored, and an empty table gives
    an empty table. ``kept`` is binary and may cut through a character; ``text`` is the same less such parts of characters.
    With ``passage``, another length of at least ``gram``, a column ``rest`` follows: the text less repeated strings of
    that many bytes, cut like ``text``.
    """
    keyed, spans = repeated_spans(docs, (length,) if passage in (None, length) else (length, passage), gram, busy)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("length", "lo", "hi")).alias("spans"))
    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    fields = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "text": pa.string()}
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, text string"
    if passage is not None:
        fields, schema = fields | {"rest": pa.string()}, f"{schema}, rest string"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, found in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                cuts = {x: [] for x in (length, passage)}
                for x in found or ():
                    cuts[x["length"]].append((x["lo"], x["hi"]))
                pieces, removed, runs = kept_pieces(text, cuts[length])
                row = (len(text), removed, runs, b"".join(pieces), _readable(pieces))
                rows.append(row if passage is None else (*row, _readable(kept_pieces(text, cuts[passage])[0])))
            return pa.record_batch([batch["doc_id"], *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), fields.values(), strict=True))], ["doc_id", *fields])

        return step

    return map_batches(joined.withColumn("doc_id", F.col("doc_id").cast("long")), schema, make)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, busy: int = BUSY) -> DataFrame:
    """``docs`` with repeated byte strings taken out of the texts, and rows dropped of which nothing was left.

    As all places of a repeated string go, and equal texts therefore wholly, this suits texts without near-duplicates.
    Texts that had nothing to take out stay as they were, null and empty ones too. A character that a cut went through
    goes. A column ``n_chars`` follows the text; other columns stay.
    """
    keyed, spans = repeated_spans(docs, (length,), gram, busy)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    own = docs.select(F.struct("*").alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(utf8()).alias("k2"))
    joined = own.join(spans, ["k1", "k2"], "left")

    def without(texts: list, found: list) -> list:
        out = []
        for text, cut in zip(texts, found, strict=True):
            if text is not None and cut:
                pieces, _, _ = kept_pieces(text.encode(), [(x["lo"], x["hi"]) for x in cut])
                text = _readable(pieces)
            out.append(text)
        return out

    @F.arrow_udf(StringType())
    def rest(texts: pa.Array, found: pa.Array) -> pa.Array:
        return by_slices(without, pa.string(), texts, found)

    kept = joined.withColumn("text", rest("text", "spans")).where("spans is null or text != ''")
    fields = {f.name: F.col("row")[f.name] for f in docs.schema}
    fields["text"] = F.col("text")
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("spans").isNull(), fields["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[c.alias(name) for name, c in fields.items()])

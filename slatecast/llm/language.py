"""Language-model scores by online logistic context mixing.

A text is foretold token by token in bits, and every bit by a mixer (``mixer``): whether the token is one that followed
the two words before it anywhere else in the corpus; if not, what kind of word it is (a language and how frequent, or
unknown), along the branches of the kind's number; and, if the corpus does not know it, its bytes and its end. What the
bits leave open is settled by relative frequency: of classes of words (their hashes' first bits) among those that followed
the two words, of a word within its class, and among the words of a kind.

What the corpus knows is counted exactly for all of it, in tables that grow with it: words, and hashed pairs of words with the
classes that follow them. Where pairs share a slot or words a class, the chances of all next tokens still add up to one at
most: a slot's classes are counted under that slot alone, and a class' chance is shared out among its words. A training
document is foretold by the other ones: its own share is taken off every count. Weights, refinements and the mixers' own tables are learned online along a bucket of texts, which are dealt and ordered by
hashes, so that scores do not depend on how the input is partitioned. Held-out texts teach nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatecast.llm.common import checkpoint, held_out, mix64, release, segments, utf8
from slatecast.llm.mixer import LIMIT, Mixer, Speller
from slatecast.llm.spotsigs import COMMON_BY_LANGUAGE

FOLDS, TEST_FOLD = 7, 2
#: Bytes of text in a bucket of documents that are scored along one stream, and in the texts whose counts one task adds up.
BUCKET_BYTES, PART_BYTES = 6_000_000, 12_000_000
#: Tokens that are foretold before they are learned; steps double from the first on.
FIRST_STEP, STEP = 64, 8192
LANGUAGES = len(COMMON_BY_LANGUAGE)
#: Kinds: three bits of language (LANGUAGES is none of them, the last is no word of the corpus), then as many of frequency, in steps of three half bits.
LANGUAGE_BITS, BAND_BITS, BAND_STEP = 3, 3, 6
UNKNOWN, BANDS = (1 << LANGUAGE_BITS) - 1, 1 << BAND_BITS
#: Half bits that a count can have.
HALVES = 128


def pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()) if len(values) else b""


def unpack(blob: bytes, kind: type | np.dtype) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_counts(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest needs, which the first byte tells, compressed."""
    size = next(k for k in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * k - (k == 8)))
    return bytes([size]) + pack(values.astype(f"u{size}"))


def unpack_counts(blob: bytes) -> np.ndarray:
    return unpack(blob[1:], np.dtype(f"u{blob[0]}")).astype(np.int64)


def halves(counts: np.ndarray) -> np.ndarray:
    """Twice the logarithm of a count, rounded down."""
    return np.floor(2 * np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64)


def kinds(counts: np.ndarray, language: np.ndarray, tokens: int) -> np.ndarray:
    """The kind of a word with these counts among so many tokens."""
    rarity = halves(np.array([max(tokens, 1)]))[0] - halves(counts)
    return language * BANDS + BANDS - 1 - np.minimum(rarity // BAND_STEP, BANDS - 1)


_LANGUAGE_OF = {w.encode(): k for k, line in reversed(list(enumerate(COMMON_BY_LANGUAGE))) for w in line.split()}


class Bucket:
    """The tokens of some texts laid end to end: distinct words in the order of their hashes, and an end (the empty word) after each text."""

    def __init__(self, raws: list[bytes], learned: np.ndarray, bits: int, class_bits: int) -> None:
        words, lengths = [], []
        for raw in raws:
            own = raw.lower().split()
            words += own
            words.append(b"")
            lengths.append(len(own) + 1)
        self.lengths = np.array(lengths, np.int64)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        del words
        names = coded.dictionary.to_pylist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w, 7) for w in names], np.uint64)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(names), np.int32)
        rank[order] = np.arange(len(names), dtype=np.int32)
        self.words, self.hashes = [names[k] for k in order], hashes[order]
        self.word = rank[coded.indices.to_numpy()]
        self.starts, self.text = segments(self.lengths)
        self.learned = learned
        self.teaches = learned[self.text]
        self.first = np.zeros(len(self.word), bool)
        self.first[self.starts] = True
        h = self.hashes[self.word] if len(self.word) else np.zeros(0, np.uint64)
        one = self.before(h, 1)
        context = mix64(one * np.uint64(0x9E3779B97F4A7C15) + mix64(self.before(one, 2)))
        self.bits, self.class_bits = bits, class_bits
        self.context = context >> np.uint64(64 - bits)
        #: What follows a pair, as its slot and the class of the next word.
        self.follows = (self.context << np.uint64(class_bits)) | (h >> np.uint64(64 - class_bits))

    def before(self, values: np.ndarray, filler: int) -> np.ndarray:
        """For each token the value of the one before it in its text."""
        out = np.roll(values, 1)
        out[self.first] = filler
        return out

    def counted(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct slots of all tokens in order, and how many tokens of texts that teach are there."""
        both = np.sort((slots << np.uint64(1)) | self.teaches.astype(np.uint64))
        slot = both >> np.uint64(1)
        heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(slot)), bool), slot[1:] != slot[:-1]]))
        return slot[heads], np.add.reduceat((both & np.uint64(1)).astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)

    def own_classes(self, own: np.ndarray) -> np.ndarray:
        """For each token how many of its own text have a word of its class, from how many have its word."""
        classes = self.hashes >> np.uint64(64 - self.class_bits)
        same = classes[1:] == classes[:-1]
        shared = np.flatnonzero((np.concatenate([[False], same]) | np.concatenate([same, [False]]))[self.word]) if len(classes) else np.zeros(0, np.int64)
        out = own.copy()
        out[shared] = self.places(classes[self.word[shared]], shared)[1]
        return out

    def places(self, slots: np.ndarray, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """For each token (or those ``at`` some places) the rank of its slot among the distinct ones, and how many tokens of its own text are there."""
        texts = self.text[at]
        n, width = len(slots), len(self.lengths).bit_length()
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if int(slots.max()).bit_length() + width <= 64:
            order = np.argsort((slots.astype(np.uint64) << np.uint64(width)) | texts.astype(np.uint64))
        else:
            order = np.argsort(slots, kind="stable")
        slot, text = slots[order], texts[order]
        new = np.concatenate([[True], slot[1:] != slot[:-1]])
        heads = np.flatnonzero(new | np.concatenate([[True], text[1:] != text[:-1]]))
        sizes = np.diff(np.append(heads, n))
        rank, own = np.empty(n, np.int64), np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        own[order] = np.repeat(sizes, sizes)
        return rank, own

    def word_counts(self) -> np.ndarray:
        """For each distinct word and language how often texts of that language which teach have it; a text's language is the one with most common words in it."""
        of_word = np.array([_LANGUAGE_OF.get(w, LANGUAGES) for w in self.words], np.int64)
        hits = np.bincount(self.text * (LANGUAGES + 1) + of_word[self.word], minlength=len(self.lengths) * (LANGUAGES + 1)).reshape(-1, LANGUAGES + 1)[:, :LANGUAGES]
        language = np.where(hits.max(axis=1) > 0, hits.argmax(axis=1), LANGUAGES)
        cell = (self.word.astype(np.int64) * (LANGUAGES + 1) + language[self.text])[self.teaches]
        return np.bincount(cell, minlength=len(self.words) * (LANGUAGES + 1)).reshape(-1, LANGUAGES + 1)


#: What is asked about: words by hash, and slots of two words with the classes that follow.
WORDS, PAIRS = range(2)
#: Bits of a key by which it is dealt at a time: who asks makes at most this power of two of rows of each kind.
FAN_BITS = 12
_ASKED = "what byte, part int, origin int, bucket int, keys binary, sizes binary, classes binary, counts binary"
_ANSWERED = "what byte, part int, origin int, bucket int, facts binary, more binary, languages binary, cell int, n long"


def _steps(keys: np.ndarray) -> bytes:
    """Ascending numbers by their differences, packed."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _widths(parts: int, most: int) -> list[int]:
    """How many first bits of a key tell its part, hop by hop, none of which deals by more than ``most`` bits."""
    bits = parts.bit_length() - 1
    hops = max(1, -(-bits // most))
    return [bits * k // hops for k in range(1, hops + 1)]


def _heads(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


Asked = tuple[int, int, int, int, bytes, bytes | None, bytes | None, bytes]


def _dealt(what: int, origin: int, asker: int, keys: np.ndarray, counts: np.ndarray, bits: int, class_bits: int, width: int) -> Iterator[Asked]:
    """Distinct keys in order with their counts, a row for each part that has some, so that the work is bounded by the keys.

    Of pairs go out the slots, how many classes follow each, these classes and their counts. The words of a class stay in one part.
    """
    slots, size = (keys, 64) if what == WORDS else (keys >> np.uint64(class_bits), bits)
    part = slots >> np.uint64(size - (min(width, class_bits) if what == WORDS else width))
    first = _heads(part)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True) if len(keys) else ():
        packed = pack_counts(counts[a:b].reshape(-1))
        if what == WORDS:
            yield what, int(part[a]), origin, asker, _steps(slots[a:b]), None, None, packed
        else:
            heads = _heads(slots[a:b])
            classes = (keys[a:b] & np.uint64((1 << class_bits) - 1)).astype(np.uint32)
            yield what, int(part[a]), origin, asker, _steps(slots[a:b][heads]), pack_counts(np.diff(heads, append=b - a)), pack(classes), packed


def _asked(bucket: int, held: Bucket, width: int) -> Iterator[Asked]:
    """A bucket's distinct keys with its own counts, for each part of the keys."""
    yield from _dealt(WORDS, 0, bucket, held.hashes, held.word_counts(), held.bits, held.class_bits, width)
    yield from _dealt(PAIRS, 0, bucket, *held.counted(held.follows), held.bits, held.class_bits, width)


def _asked_table(rows: Iterator[Asked]) -> pa.Table:
    kinds_of = (pa.int8(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
    names = ["what", "part", "origin", "bucket", "keys", "sizes", "classes", "counts"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds_of, strict=True)], names)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of all buckets, the sums of their counts, and the place of each bucket's keys among them; a bucket has a key once."""
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros((len(distinct), width), np.int64)
    at = 0
    for own, count in zip(keys, counts, strict=True):
        sums[index[at : at + len(own)]] += count.reshape(-1, width)
        at += len(own)
    return distinct, sums, index


def _group_sums(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each place the sum of the values in its group; equal groups stand together."""
    heads = _heads(groups)
    return np.repeat(np.add.reduceat(values, heads), np.diff(heads, append=len(groups))) if len(heads) else values


def _merged(table: pa.Table, class_bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """What some ask one part for: the distinct keys, sums of their counts, and for each row the places of its keys and which of them begin a slot."""
    what = table["what"][0].as_py()
    keys = [np.cumsum(unpack(b, np.uint64), dtype=np.uint64) for b in table["keys"].to_pylist()]
    counts = [unpack_counts(b) for b in table["counts"].to_pylist()]
    leads = []
    if what == PAIRS:
        sizes = [unpack_counts(b) for b in table["sizes"].to_pylist()]
        leads = [np.cumsum(size) - size for size in sizes]
        keys = [(np.repeat(slots, size) << np.uint64(class_bits)) | unpack(b, np.uint32) for slots, size, b in zip(keys, sizes, table["classes"].to_pylist(), strict=True)]
    distinct, sums, index = _summed(keys, counts, LANGUAGES + 1 if what == WORDS else 1)
    ends = np.cumsum([len(k) for k in keys])
    return distinct, sums, [index[e - len(k) : e] for e, k in zip(ends, keys, strict=True)], leads


def _told(table: pa.Table, facts: list[bytes], more: list[bytes], languages: list[bytes | None], cells: np.ndarray) -> pa.Table:
    """The answers to the rows of ``table``, and the filled cells as rows of their own."""
    filled = np.flatnonzero(cells)
    n, m = len(facts), len(filled)
    return pa.table({
        "what": pa.array([table["what"][0].as_py()] * (n + m), pa.int8()),
        **{name: pa.array([*table[name].to_pylist(), *[-1] * m], pa.int32()) for name in ("part", "origin", "bucket")},
        **{name: pa.array([*values, *[None] * m], pa.binary()) for name, values in (("facts", facts), ("more", more), ("languages", languages))},
        "cell": pa.array([*[-1] * n, *filled.tolist()], pa.int32()),
        "n": pa.array([*[0] * n, *cells[filled].tolist()], pa.int64()),
    })


def _answered(table: pa.Table, class_bits: int) -> pa.Table:
    """The corpus' exact counts of all keys that one part is asked for, to each who asks in the order of its keys; and, as rows of
    their own, how many words and tokens there are by language and frequency.

    Of a word also go out what the other words of its class count together, and its language; of a class that follows a pair, the pair's count once a pair.
    """
    distinct, sums, cuts, leads = _merged(table, class_bits)
    total = sums.sum(axis=1)
    facts = [pack_counts(total[c]) for c in cuts]
    if table["what"][0].as_py() == PAIRS:
        slot = _group_sums(distinct >> np.uint64(class_bits), total)
        return _told(table, facts, [pack_counts(slot[c[lead]]) for c, lead in zip(cuts, leads, strict=True)], [None] * len(cuts), np.zeros(0, np.int64))
    language = np.where(sums.max(axis=1) * 2 > total, sums.argmax(axis=1), LANGUAGES).astype(np.uint8)
    cell = language.astype(np.int64) * HALVES + halves(total)
    seen = total > 0
    cells = np.concatenate([np.bincount(cell[seen], total[seen], minlength=(LANGUAGES + 1) * HALVES).astype(np.int64), np.bincount(cell[seen], minlength=(LANGUAGES + 1) * HALVES)])
    beside = _group_sums(distinct >> np.uint64(64 - class_bits), total) - total
    return _told(table, facts, [pack_counts(beside[c]) for c in cuts], [pack(language[c]) for c in cuts], cells)


def _forwarded(table: pa.Table, bits: int, class_bits: int, width: int) -> pa.Table:
    """What a block of askers asks one part for, asked once for all of them, for each of the finer parts."""
    distinct, sums, _, _ = _merged(table, class_bits)
    return _asked_table(_dealt(table["what"][0].as_py(), table["part"][0].as_py(), table["block"][0].as_py(), distinct, sums, bits, class_bits, width))


def _returned(table: pa.Table, told: pa.Table, class_bits: int) -> pa.Table:
    """The answers that a block got, to each of its askers."""
    distinct, _, cuts, leads = _merged(table, class_bits)
    told = told.sort_by("part")
    facts, more = (_joined([unpack_counts(b) for b in told[name].to_pylist()]) for name in ("facts", "more"))
    own = [pack_counts(facts[c]) for c in cuts]
    if table["what"][0].as_py() == PAIRS:
        slots = distinct >> np.uint64(class_bits)
        place = np.cumsum(np.concatenate([[0], slots[1:] != slots[:-1]]))
        return _told(table, own, [pack_counts(more[place[c[lead]]]) for c, lead in zip(cuts, leads, strict=True)], [None] * len(cuts), np.zeros(0, np.int64))
    languages = _joined([unpack(b, np.uint8) for b in told["languages"].to_pylist()]).astype(np.uint8)
    return _told(table, own, [pack_counts(more[c]) for c in cuts], [pack(languages[c]) for c in cuts], np.zeros(0, np.int64))


class Known:
    """The corpus' counts for a bucket's keys in their order: distinct words, all words of their classes, languages; distinct slots of two words, and classes that follow."""

    def __init__(self, told: pa.Table) -> None:
        told = told.sort_by("part")
        got = [told.filter(pa.compute.equal(told["what"], what)) for what in (WORDS, PAIRS)]
        facts, more = ([_joined([unpack_counts(b) for b in t[name].to_pylist()]) for t in got] for name in ("facts", "more"))
        self.words, self.follows = facts
        self.classes, self.contexts = more[WORDS] + self.words, more[PAIRS]
        self.languages = _joined([unpack(b, np.uint8) for b in got[WORDS]["languages"].to_pylist()])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)


class Corpus:
    """What is known of all training tokens: their number, that of distinct words, and tokens by kind."""

    def __init__(self, cells: np.ndarray) -> None:
        by_count, words = cells.reshape(2, LANGUAGES + 1, HALVES)
        self.tokens, self.distinct = int(by_count.sum()), int(words.sum())
        size = 1 << (LANGUAGE_BITS + BAND_BITS)
        language, half = np.divmod(np.arange((LANGUAGES + 1) * HALVES), HALVES)
        rarity = halves(np.array([max(self.tokens, 1)]))[0] - half
        kind = language * BANDS + BANDS - 1 - np.clip(rarity // BAND_STEP, 0, BANDS - 1)
        self.by_kind = np.bincount(kind, by_count.reshape(-1), minlength=size)
        # words that are new come about as often as those that were met once
        mass = self.by_kind.copy()
        mass[UNKNOWN * BANDS] += words[:, 0].sum() + 1
        # along the branches of the kinds' numbers: the log odds of a one
        self.odds = np.zeros(size)
        for depth in range(LANGUAGE_BITS + BAND_BITS):
            halved = mass.reshape(2 << depth, -1).sum(axis=1)
            self.odds[(1 << depth) : (2 << depth)] = np.clip(np.log((halved[1::2] + 0.5) / (halved[::2] + 0.5)), -LIMIT, LIMIT)


class Scorer:
    """The mixers of one stream of texts."""

    def __init__(self, corpus: Corpus) -> None:
        self.corpus = corpus
        self.again = Mixer(3, 1, 16, 18)
        self.kind = Mixer(5, 1, (LANGUAGE_BITS + BAND_BITS) * 2, 18)
        self.speller = Speller()

    def run(self, held: Bucket, known: Known) -> np.ndarray:
        """The log10 chance of each token, from the corpus' counts.

        After any beginning the chances of all next tokens add up to one at most: a word that followed is a class among
        those that did, then a word of that class; any other is a kind and a word of that kind, or is spelled.
        """
        corpus = self.corpus
        own = held.places(held.word)[1]
        beside = known.classes[held.word] - held.own_classes(own) * held.teaches
        own = own * held.teaches
        others = known.words[held.word] - own
        kind = np.where(others > 0, kinds(known.words[held.word], known.languages[held.word], corpus.tokens), UNKNOWN * BANDS)
        rank, mine = held.places(held.context)
        after = known.contexts[rank] - mine * held.teaches
        rank, mine = held.places(held.follows)
        same = known.follows[rank] - mine * held.teaches
        hit = (same > 0) & (others > 0)
        # what is known when a token is foretold: how the tokens before it came out, and their kinds
        state = np.where(hit, 2, np.where(after > 0, 1, 0))
        past = [held.before(state, 3)]
        for _ in range(2):
            past.append(held.before(past[-1], 3))
        at = np.arange(len(state))
        run = at - 1 - held.before(np.maximum.accumulate(np.where(hit & ~held.first, -1, at)), -1) if len(at) else at
        run = np.where(held.first, 0, np.minimum(run, 20))
        level = np.minimum(np.log2(np.maximum(after, 1)).astype(np.int64), 6)
        spoken = [held.before(kind, 0)]
        spoken.append(held.before(spoken[0], 0))
        tongue = [k // BANDS for k in spoken]
        leading = self._leading(held, kind // BANDS)
        last = held.before(held.word.astype(np.int64), -1)
        name = np.where(last >= 0, held.hashes[last] if len(held.hashes) else 0, np.uint64(0))
        chance = np.zeros(len(state))
        again = [past[0] + 4 * past[1] + 16 * past[2] + 64 * level, run * 8 + level, name]
        kinds_of = [spoken[0], spoken[0] * 256 + spoken[1], (tongue[0] * 8 + tongue[1]) * 8 + leading, name, (state * 8 + level) * 8 + leading]
        a, size = 0, FIRST_STEP
        while a < len(state):
            b = min(a + size, len(state))
            teach = held.teaches[a:b]
            some = np.flatnonzero(after[a:b] > 0) + a
            slots = self.again.slots([v[some] for v in again], np.ones(len(some)))
            chance[some] += self.again.run(slots, np.ones((1, len(some))), past[0][some] * 4 + past[1][some], hit[some].astype(np.int64), teach[some - a])
            got = some[hit[some]]
            chance[got] += np.log10(same[got] / after[got]) + np.log10(others[got] / beside[got])
            rest = np.flatnonzero(~hit[a:b]) + a
            chance[rest] += self._kinds(kind[rest], [v[rest] for v in kinds_of], state[rest], teach[rest - a])
            met = rest[others[rest] > 0]
            chance[met] += np.log10(others[met] / np.maximum(corpus.by_kind[kind[met]] - own[met], others[met]))
            new = rest[others[rest] <= 0]
            before = [held.words[k] if k >= 0 else b"" for k in last[new]]
            chance[new] += self.speller.run([held.words[k] for k in held.word[new]], before, teach[new - a])
            a, size = b, min(size * 2, STEP)
        return chance

    @staticmethod
    def _leading(held: Bucket, language: np.ndarray) -> np.ndarray:
        """The language that most words of the text so far have, LANGUAGES while there are none."""
        sums = []
        for k in range(LANGUAGES):
            total = np.cumsum(language == k) - (language == k)
            sums.append(total - total[held.starts][held.text] if len(total) else total)
        every = np.stack(sums)
        return np.where(every.max(axis=0) > 0, every.argmax(axis=0), LANGUAGES) if every.size else np.zeros(0, np.int64)

    def _kinds(self, kind: np.ndarray, contexts: list[np.ndarray], state: np.ndarray, teach: np.ndarray) -> np.ndarray:
        depths = LANGUAGE_BITS + BAND_BITS
        # an unknown word has no bits of frequency
        first, of = segments(np.where(kind == UNKNOWN * BANDS, LANGUAGE_BITS, depths))
        depth = np.arange(len(of)) - first[of]
        node = (kind[of] + (1 << depths)) >> (depths - depth)
        slots = self.kind.slots([c[of] for c in contexts], node)
        right = self.kind.run(slots, self.corpus.odds[node][None], depth * 2 + (state[of] > 0), (kind[of] >> (depths - 1 - depth)) & 1, teach[of])
        return np.add.reduceat(right, first) if len(first) else right


def _plan(docs: DataFrame) -> tuple[int, int, int, int]:
    """How many buckets and parts there are, and the bits of a slot and of a class: by the size of the texts alone, not by their partitions.

    Slots and classes fit into one number of 63 bits, so from 64 GB on they grow no more; at 100 TB a slot has a few pairs. Counts stay exact.
    """
    size = int(docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("n")).first()["n"] or 0)
    return max(1, -(-size // BUCKET_BYTES)), 1 << max(3, (size // PART_BYTES).bit_length()), min(41, max(20, size.bit_length() + 5)), min(22, max(16, size.bit_length() - 4))


def judge(docs: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` for every row of ``docs``.

    ``base_score`` is the add-one unigram score and ``score`` the model's, both log10. A null text is empty and has its
    end for a token; a null id is in the fold of the empty string; repeated rows each come out; other columns are
    ignored; an empty table gives an empty table. Where no document is learned from, all counts are zero.

    Keys are dealt by at most ``fan_bits`` bits at a time. Where parts are more, as many buckets as a hop has parts ask
    together: their keys are merged, dealt further, and the answers handed back the same way. So a bucket's rows do not
    grow with the corpus, a word that all buckets have is asked for by few, and scores are the same.
    """
    buckets, parts, bits, class_bits = _plan(docs)
    widths = _widths(parts, fan_bits)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(), held_out("doc_id", FOLDS, TEST_FOLD).alias("held_out"))
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [tool.compress(memoryview(t.as_buffer())) for t in batch["text"]]
            yield pa.record_batch([batch["doc_id"], pa.array(packed, pa.binary()), batch["held_out"], batch["bucket"]], names=["doc_id", "text", "held_out", "bucket"])

    # texts cross the network twice, compressed
    dealt = rows.select("*", bucket).mapInArrow(squeeze, "doc_id long, text binary, held_out boolean, bucket int").repartition(max(buckets, spread), "bucket")

    def opened(table: pa.Table) -> tuple[pa.Table, Bucket]:
        """The texts of a bucket in an order of their own, whatever order they come in."""
        tool = zstandard.ZstdDecompressor()
        raws = [tool.decompress(t) for t in table["text"].to_pylist()]
        ids = table["doc_id"].to_pylist()
        order = sorted(range(len(raws)), key=lambda k: (xxhash.xxh64_intdigest(raws[k], 11), ids[k] is None, ids[k] or 0))
        table = table.select(["doc_id", "held_out"]).take(pa.array(order, pa.int64()))
        return table.append_column("n_bytes", pa.array([len(raws[k]) for k in order], pa.int64())), Bucket([raws[k] for k in order], ~table["held_out"].to_numpy(zero_copy_only=False), bits, class_bits)

    def ask(table: pa.Table) -> pa.Table:
        name = table["bucket"][0].as_py()
        out = _asked_table(_asked(name, opened(table)[1], widths[0]))
        release()
        return out

    def answer(table: pa.Table) -> pa.Table:
        out = _answered(table, class_bits)
        release()
        return out

    def forward(width: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            out = _forwarded(table, bits, class_bits, width)
            release()
            return out

        return run

    asked, hops = dealt.groupBy("bucket").applyInArrow(ask, _ASKED), []
    for last, near, far in zip([0, *widths], widths, widths[1:], strict=False):
        hops.append(checkpoint(asked.withColumn("block", F.shiftright("bucket", near - last))))
        asked = hops[-1].groupBy("what", "part", "block").applyInArrow(forward(far), _ASKED)
    answers = checkpoint(asked.groupBy("what", "part").applyInArrow(answer, _ANSWERED))
    # at most 2 * (LANGUAGES + 1) * HALVES rows, however large the corpus
    cells = np.zeros(2 * (LANGUAGES + 1) * HALVES, np.int64)
    for row in answers.where("bucket < 0").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[row["cell"]] = row["n"]
    corpus = Corpus(cells)
    told = answers.where("bucket >= 0")

    def hand_back(table: pa.Table, told: pa.Table) -> pa.Table:
        out = _returned(table, told, class_bits)
        release()
        return out

    for hop in reversed(hops):
        told = hop.groupBy("what", "part", "block").cogroup(told.groupBy("what", "origin", "bucket")).applyInArrow(hand_back, _ANSWERED)

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        table, held = opened(texts)
        known = Known(told)
        counts = known.words[held.word]
        model = np.add.reduceat(Scorer(corpus).run(held, known), held.starts)
        base = np.log10(counts + 1.0) - np.log10(corpus.tokens + corpus.distinct + 1.0)
        out = pa.table({
            "doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": held.lengths, "n_known": np.add.reduceat((counts > 0).astype(np.int64), held.starts),
            "train_tokens": np.full(len(model), corpus.tokens, np.int64), "base_score": np.add.reduceat(base, held.starts), "score": model,
            "bits_per_byte": -model / np.log10(2) / np.maximum(table["n_bytes"].to_numpy(), 1),
        })
        del held
        release()
        return out

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(score, schema)

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from slatecast.llm import language, mixer


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def test_spelling_is_a_complete_code():
    size, node, branch = mixer.spelling()
    assert sum(2.0 ** -int(n) for n in size) == 1
    paths = {tuple(branch[s, : size[s]]) for s in range(257)}
    assert len(paths) == 257
    steps = {}
    for s in range(257):
        for k in range(size[s]):
            assert steps.setdefault(int(node[s, k]), tuple(branch[s, :k])) == tuple(branch[s, :k])


def test_mixer_against_a_loop():
    """Steps of bits, foretold and learned one value at a time."""
    rng = np.random.default_rng(3)
    made = mixer.Mixer(3, 1, 2, 6)
    counts, weights = defaultdict(float), np.full((2, 4), mixer.FIRST)
    moved = np.full((2, 4), 1e-4)
    level = lambda k: 1 / (1 + math.exp(-(-mixer.LIMIT + 2 * mixer.LIMIT * k / (mixer.LEVELS - 1))))
    seen = {(g, k): [mixer.TRUST * (1 - level(k)), mixer.TRUST * level(k)] for g in range(2) for k in range(mixer.LEVELS)}
    odds = lambda k, s: math.log((counts[k, s, 1] + mixer.PRIOR) / (counts[k, s, 0] + mixer.PRIOR))
    for n in (5, 9, 40):
        slots, extra, gate = rng.integers(0, 64, (3, n)), rng.normal(size=(1, n)), rng.integers(0, 2, n)
        came, learn = rng.integers(0, 2, n), rng.random(n) < 0.8
        got = made.run(slots, extra, gate, came, learn)
        later, slopes = [], np.zeros((2, 4))
        for i in range(n):
            inputs = [*(odds(k, slots[k, i]) for k in range(3)), extra[0, i]]
            mixed = max(-mixer.LIMIT, min(mixer.LIMIT, sum(w * x for w, x in zip(weights[gate[i]], inputs, strict=True))))
            chance = 1 / (1 + math.exp(-mixed))
            cell = (int(gate[i]), round((mixed + mixer.LIMIT) * (mixer.LEVELS - 1) / (2 * mixer.LIMIT)))
            refined = (chance + seen[cell][1] / sum(seen[cell])) / 2
            assert got[i] == pytest.approx(math.log10(refined if came[i] else 1 - refined), abs=1e-5)
            if learn[i]:
                slopes[gate[i]] += [(came[i] - chance) * x for x in inputs]
                later.append((cell, i))
        for g in range(2):
            slope = slopes[g] / max(1, sum(learn & (gate == g)))
            moved[g] += slope**2
            weights[g] += mixer.RATE * slope / np.sqrt(moved[g])
        for cell, i in later:
            seen[cell][came[i]] += 1
            for k in range(3):
                counts[k, slots[k, i], came[i]] += 1
    assert np.allclose(made.weights, weights, atol=1e-4)


def test_a_speller_gives_all_words_one_chance_together():
    """Over all endings of a beginning, bytes and the end of the word, the chances add up to one."""
    size = mixer.spelling()[0]
    total = 0.0
    for symbol in range(257):
        speller = mixer.Speller(12)
        words = [b"abba", b"abc", b"", b"abd"] * 4
        speller.run(words, [b"x"] * len(words), np.ones(len(words), bool))
        bits = []
        inner = speller.mixer.run
        speller.mixer.run = lambda *a, inner=inner: bits.append(inner(*a)) or bits[-1]
        speller.run([b"ab" + bytes([symbol]) if symbol < 256 else b"ab"], [b"x"], np.zeros(1, bool))
        before = sum(size[c] for c in b"ab")
        total += 10.0 ** bits[0][before : before + size[symbol]].sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_spelling_steps_change_nothing_but_what_was_learned_before(prose):
    """Words cut by the end of a step have all their bits, and contexts reach over the cut."""
    words = [w.encode() for w in prose(300).split()]
    one = mixer.Speller(12).run(words, [b"", *words[:-1]], np.zeros(len(words), bool))
    old, mixer.SPELL_STEP = mixer.SPELL_STEP, 7
    try:
        assert np.allclose(one, mixer.Speller(12).run(words, [b"", *words[:-1]], np.zeros(len(words), bool)))
    finally:
        mixer.SPELL_STEP = old


def bucket(texts, learned, bits=40, class_bits=20):
    return language.Bucket([t.encode() for t in texts], np.array(learned), bits, class_bits)


def grouped(rows, *names):
    """The rows of a table with equal values of ``names``, a table each."""
    keys = {tuple(r[n] for n in names) for r in rows}
    return {key: pa.Table.from_pylist([r for r in rows if tuple(r[n] for n in names) == key]) for key in keys}


def answers(held, widths, class_bits):
    """All rows that answer what some buckets ask, by way of hops."""
    bits = held[0].bits
    asked = language._asked_table(a for k, h in enumerate(held) for a in language._asked(k, h, widths[0])).to_pylist()
    hops = []
    for last, near, far in zip([0, *widths], widths, widths[1:], strict=False):
        hops.append(grouped([{**r, "block": r["bucket"] >> (near - last)} for r in asked], "what", "part", "block"))
        asked = [r for t in hops[-1].values() for r in language._forwarded(t, bits, class_bits, far).to_pylist()]
    rows = [r for t in grouped(asked, "what", "part").values() for r in language._answered(t, class_bits).to_pylist()]
    cells, rows = [r for r in rows if r["bucket"] < 0], [r for r in rows if r["bucket"] >= 0]
    for hop in reversed(hops):
        told = grouped(rows, "what", "origin", "bucket")
        assert set(told) == set(hop)
        rows = [r for key, t in hop.items() for r in language._returned(t, told[key], class_bits).to_pylist()]
    return rows + cells


def known(rows, k):
    return language.Known(pa.Table.from_pylist([r for r in rows if r["bucket"] == k]))


def corpus_of(rows):
    cells = np.zeros(2 * (language.LANGUAGES + 1) * language.HALVES, np.int64)
    for r in rows:
        if r["bucket"] < 0:
            cells[r["cell"]] += r["n"]
    return language.Corpus(cells)


@pytest.mark.parametrize("bits", [32, 41])
def test_counts_of_a_bucket_against_a_loop(prose, bits):
    texts = [prose(60), prose(5), "", "a b a b a c", "a b a c a b"]
    learned = [True, True, False, True, True]
    held = bucket(texts, learned, bits)
    tokens = [[*t.encode().split(), b""] for t in texts]
    triples = [[(*([None, None] + own)[k : k + 2], w) for k, w in enumerate(own)] for own in tokens]
    for slots, size in ((held.follows, 3), (held.context, 2)):
        distinct, counts = held.counted(slots)
        rank, mine = held.places(slots)
        want = Counter(t[:size] for own, teaches in zip(triples, learned, strict=True) if teaches for t in own)
        at = 0
        for own in triples:
            for t in own:
                assert counts[rank[at]] == want[t[:size]] and distinct[rank[at]] == slots[at]
                assert mine[at] == sum(x[:size] == t[:size] for x in own)
                at += 1
    words = [w for own in tokens for w in own]
    assert [held.words[k] for k in held.word] == words
    own = held.places(held.word)[1]
    assert own.tolist() == [t.count(w) for t in tokens for w in t]
    held.class_bits = 3
    classes = [[int(h) >> 61 for h in held.hashes[held.word[a : a + n]]] for a, n in zip(held.starts, held.lengths, strict=True)]
    assert held.own_classes(own).tolist() == [c.count(x) for c in classes for x in c]


@pytest.mark.parametrize("widths", [[2], [1, 2], [2, 3, 5]])
@pytest.mark.parametrize(("bits", "class_bits"), [(40, 20), (6, 3)])
def test_asked_and_answered(prose, bits, class_bits, widths):
    """Buckets ask in parts, straight or by hops, past the bits of a class too; each gets the sums of both, in the order of its own keys, however great they are."""
    texts = [[prose(80), "of the a " * 300], [prose(90), prose(200), "of the a " * 200]]
    held = [bucket(t, [True, k == 1, True][: len(t)], bits, class_bits) for k, t in enumerate(texts)]
    rows = answers(held, widths, class_bits)
    every = {}
    for what in ("words", "classes", "contexts", "follows"):
        every[what] = Counter()
    for h in held:
        for w, c, f, teaches in zip(h.hashes[h.word].tolist(), h.context.tolist(), h.follows.tolist(), h.teaches, strict=True):
            for what, key in (("words", w), ("classes", w >> (64 - class_bits)), ("contexts", c), ("follows", f)):
                every[what][key] += int(teaches)
    for k, h in enumerate(held):
        got = known(rows, k)
        assert got.words.tolist() == [every["words"][w] for w in h.hashes.tolist()]
        assert got.classes.tolist() == [every["classes"][w >> (64 - class_bits)] for w in h.hashes.tolist()]
        assert got.contexts.tolist() == [every["contexts"][c] for c in np.unique(h.context).tolist()]
        assert got.follows.tolist() == [every["follows"][f] for f in np.unique(h.follows).tolist()]
        assert got.languages.shape == got.words.shape
    corpus = corpus_of(rows)
    assert corpus.tokens == 81 + 91 + 201 + 601 and corpus.by_kind.sum() == corpus.tokens


@pytest.mark.parametrize(("bits", "class_bits"), [(40, 20), (5, 3), (3, 8)])
def test_the_chances_of_all_next_tokens_add_up_to_one_at_most(bits, class_bits):
    """After beginnings that are often met, met once and new; slots that many pairs share and classes of many words included."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(25)] + ["of", "the"]
    texts = [" ".join(rng.choices(vocabulary[:12] if k % 2 else vocabulary, k=80)) for k in range(24)] + ["of the w1 " * 150]
    for lead in ("of the", "w1 w2", "w24 w23", "never met"):
        total = 0.0
        for word in [*vocabulary, None]:
            held = bucket([*texts, f"{lead} {word or ''}"], [True] * len(texts) + [False], bits, class_bits)
            rows = answers([held], [2], class_bits)
            total += 10.0 ** language.Scorer(corpus_of(rows)).run(held, known(rows, 0))[held.starts[-1] + 2]
        assert 0.3 < total <= 1 + 1e-6


def test_rows_of_a_bucket_do_not_grow_with_the_corpus():
    for parts in (8, 4096, 131_072, 1 << 24):
        widths = language._widths(parts, language.FAN_BITS)
        assert 1 << widths[-1] == parts and max(np.diff([0, *widths])) <= language.FAN_BITS


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint32, np.int64, np.uint64):
        values = rng.integers(0, 200, 300).astype(kind)
        assert np.array_equal(language.unpack(language.pack(values), kind), values)
    assert len(language.unpack(language.pack(np.zeros(0, np.int64)), np.int64)) == 0
    for most in (0, 255, 256, 65535, 65536, (1 << 32) - 1, 1 << 32, (1 << 63) - 1):
        assert language.unpack_counts(language.pack_counts(np.array([3, most], np.int64))).tolist() == [3, most]
    assert len(language.unpack_counts(language.pack_counts(np.zeros(0, np.int64)))) == 0


def test_odd_rows(odd, odd_rows, none):
    rows = language.judge(odd).collect()
    tokens = [[*(r[1] or "").encode().lower().split(), None] for r in odd_rows]
    counts = Counter(w for r, t in zip(odd_rows, tokens, strict=True) if not fold(r[0]) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = [(r[0], fold(r[0]), len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(odd_rows, tokens, strict=True)]
    same = sorted(map(repr, want)) == sorted(repr((*r[:5], round(r["base_score"], 6))) for r in rows)
    assert same
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in rows)
    assert language.judge(none).count() == 0


def test_scores_do_not_depend_on_partitions_and_find_copies(spark, prose, monkeypatch):
    monkeypatch.setattr(language, "BUCKET_BYTES", 20_000)
    texts = [prose(60) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k]) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r["doc_id"]: r for r in language.judge(docs.repartition(2)).collect()}
    two = {r["doc_id"]: r for r in language.judge(docs.repartition(7)).collect()}
    hops = {r["doc_id"]: r for r in language.judge(docs, fan_bits=1).collect()}
    assert one == hops
    assert {k: r["score"] for k, r in one.items()} == {k: r["score"] for k, r in two.items()}
    twins = [one[k]["bits_per_byte"] for k in range(10) if not fold(1000 + k)]
    others = [r["bits_per_byte"] for k, r in one.items() if 10 <= k < 1000]
    assert max(twins) < min(others) * 0.7


def test_long_words_cost_by_their_length(spark, prose):
    rng = random.Random(5)
    rows = [(k, prose(50)) for k in range(60)] + [(100 + n, "".join(rng.choices("abcdefghij", k=n))) for n in (300, 1000, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in language.judge(docs).collect()}
    assert got[5100] < 3 * got[1100] < 6 * got[400] < -3000  # some three bits a letter and more


def test_foretells_better_than_the_base(spark, prose):
    """Texts of a bounded vocabulary with copies among them: held-out texts are foretold better than by word counts."""
    texts = [prose(150) for _ in range(150)]
    rows = [(k, texts[k % 100]) for k in range(300)]
    got = language.judge(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.5 * sum(r["base_score"] for r in got)

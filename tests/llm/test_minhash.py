import random

import numpy as np
import pytest

from slatecast.llm import minhash, within
from slatecast.llm.common import checkpoint
from slatecast.llm.minhash import Sets, Sketches
from slatecast.llm.simhash import shingle_hashes, shingle_set

from .test_simhash import components


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    """The expected rows of ``(doc_id, text)`` by comparing all pairs."""
    sets = [brute_set(text) for _, text in rows]
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = components(pairs, range(len(rows)))
    out = []
    for k, (doc_id, _) in enumerate(rows):
        name = min((i for i, g in zip([r[0] for r in rows], group.values(), strict=True) if g == group[k] and i is not None), default=None)
        out.append((doc_id, len(sets[k]), name, doc_id == name))
    return sorted(map(repr, out))


def near_copies(prose, families, size, seed, words=60):
    """Families whose members differ from one another by a few words more each."""
    rng, rows = random.Random(seed), []
    for _ in range(families):
        text = prose(words).split()
        for _ in range(size):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(1, 2)):
                text[rng.randrange(len(text))] = rng.choice("alpha beta gamma delta".split())
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_sketches_tell_likeness():
    rng = np.random.default_rng(5)
    misses, wrong = [], 0
    for size in (40, 300, 3000):
        for likeness in (0.8, 0.9, 0.97, 0.4):
            for _ in range(30):
                pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64) * np.uint64(2)
                common = round(2 * size * likeness / (1 + likeness))
                a, b = np.unique(pool[:size]), np.unique(np.concatenate([pool[:common], pool[size : 2 * size - common]]))
                loads = [x + n.to_bytes(2, "little") for x, n in map(minhash.odd_sketch, (a, b))]
                near = bool(Sketches(loads, np.array([len(a), len(b)])).near(np.array([0]), np.array([1]))[0])
                if likeness >= 0.8:
                    misses.append(not near)
                else:
                    wrong += near
                if likeness >= 0.8 and size == 3000:
                    bits = [np.frombuffer(x[:-2], np.uint64) for x in loads]
                    differ = np.bitwise_count(bits[0] ^ bits[1]).sum()
                    got = minhash.estimate(np.array([differ]), np.array([512]), np.array([512]))[0]
                    assert abs(got - likeness) < 0.1
    assert not any(misses) and wrong < 5  # what is not ruled out is compared on the sets


def test_sets_are_compared_exactly():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50), dtype=np.uint64)) for _ in range(60)]
    loads = Sets([s.tobytes() for s in sets], np.array([len(s) for s in sets]))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60), indexing="ij"))
    want = [100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert loads.near(i, j).tolist() == want


def test_odd_rows_against_brute_force(odd, odd_rows, none):
    got = sorted(repr(tuple(r)) for r in minhash.near_duplicates(odd).collect())
    # of rows without an id and a group without a name, all stay
    assert got == [x.replace("None, False", "None, True") if x.startswith("(None") and x.endswith("None, False)") else x for x in brute([r[:2] for r in odd_rows])]
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("most_sketches", "most_shingles"), [(8192, 1 << 21), (7, 300)])
def test_families_against_brute_force(spark, prose, most_sketches, most_shingles):
    """Chains of near copies; with small limits all families are dealt in blocks, whose results are the same."""
    rows = near_copies(prose, 6, 40, 1) + [(1000 + k, prose(50)) for k in range(60)]
    rows += [(2000 + k, "the same short line") for k in range(50)] + [(3000 + k, f"w{k // 2} x") for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(repr(tuple(r)) for r in minhash.near_duplicates(frame, most_sketches, most_shingles).collect())
    assert got == brute(rows)


def test_links_of_leads_only():
    """Where rows lead, only they are held against the others, and what is near none of them is told."""
    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 0, 1, 50, 51, 90)]
    loads = Sets([s.tobytes() for s in sets], np.full(6, 20))
    a, b, apart = within.links_of(np.arange(6), np.zeros(6), np.array([True, False, False, False, False, False]), loads)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (0, 2)] and apart.tolist() == [3, 4, 5]
    a, b, apart = within.links_of(np.arange(6), np.zeros(6), np.zeros(6, bool), loads)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (0, 2), (3, 4)] and not len(apart)


def test_light_keys_stay_whole_beside_heavy_ones(spark, joins_turn_into_broadcasts):
    """With a key to be dealt in blocks, all others still lie in one task each, wherever their rows were read."""
    rng = np.random.default_rng(8)
    loads = [np.sort(rng.integers(0, 1 << 63, 20, dtype=np.uint64)).tobytes() for _ in range(300)]
    rows = [(key, 10 * key + k, 20, load) for key, load in enumerate(loads) for k in range(4)] + [(999, 100000 + k, 20, loads[0]) for k in range(60)]
    frame = checkpoint(spark.createDataFrame(rows, "key long, node long, size long, load binary").repartition(8))
    links = within.linked_within(frame, Sets, 1000).collect()
    assert sorted(r["b"] for r in links) == sorted([10 * key + k for key in range(300) for k in (1, 2, 3)] + [100000 + k for k in range(1, 60)])


def test_bands_meet():
    rng, missed = random.Random(9), 0
    for _ in range(200):
        words = [str(rng.random()) for _ in range(60)]
        other = [*words[:-6], *(str(rng.random()) for _ in range(6))]
        a, b = (shingle_set(shingle_hashes(" ".join(w).encode(), 4)) for w in (words, other))
        missed += not np.any(minhash.band_keys(a) == minhash.band_keys(b))
    assert missed == 0

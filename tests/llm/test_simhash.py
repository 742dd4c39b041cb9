import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from slatecast.llm import simhash, within
from slatecast.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_trie_join_finds_all_pairs_within_budget():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    values = np.unique(np.concatenate([base, near]))
    for budget in (0, 1, 4, 7):
        got = {(int(a), int(b)) for i, j in simhash.trie_links(values, np.zeros(len(values)), budget) for a, b in zip(i, j, strict=True)}
        assert got == {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= budget}


def test_block_masks_leave_no_pair_out():
    rng = np.random.default_rng(2)
    for count in (10, 10**8, 10**10):
        masks = simhash.block_masks(4, count)
        for _ in range(300):
            differ = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(differ & m == 0 for m in masks)


def test_groups_against_brute_force(odd, odd_rows):
    rows = simhash.near_duplicates(odd).collect()
    fps = [(r[0], brute_fingerprint(r[1])) for r in odd_rows]
    nodes = {f for _, f in fps}
    group = components([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4], nodes)
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[group[f]].append(i)
    want = [(i, f"{f:016x}", min(least[group[f]], default=None)) for i, f in fps]
    same = sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert same


def test_links_only_through_links_make_one_group(spark):
    start = 0x0123456789ABCDEF
    chain = [start]
    for k in range(12):
        chain.append(chain[-1] ^ (0xF << (4 * k)))
    fps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in chain], "fp long")
    found = connected_components(simhash.near_links(fps))
    assert found.count() == 13 and found.select("component").distinct().count() == 1


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(7, 7), (300, 299), (300, 299)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 1 for k in range(1, 60)} | {299: 299, 300: 299}


def test_keep_one(odd, odd_rows):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 in ids and 45 not in ids and 46 not in ids and ids.count(None) == 2 and ids.count(5) == 3


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).columns == none.columns


def edited(text, likeness, width=5):
    """``text`` with single words replaced, far apart, until the shingle sets are just ``likeness`` alike or more; and how alike they are."""
    shingles = lambda x: {tuple(x[k : k + width]) for k in range(len(x) - width + 1)}
    alike = lambda a, b: len(a & b) / len(a | b)
    now, was = text.split(), text.split()
    for k in range(2 * width, len(was) - width, 2 * width):
        more = now[:k] + [f"edit{k}"] + now[k + 1 :]
        if alike(shingles(was), shingles(more)) < likeness:
            break
        now = more
    return " ".join(now), alike(shingles(was), shingles(now))


def test_near_copies_down_to_four_fifths_go(spark, prose):
    """Copies of a likeness just over 0.8 go, of which few are within four bits; such just under 0.8 stay."""
    rows, far = [], []
    for k in range(20):
        text = prose(300)
        near, alike = edited(text, 0.8)
        assert 0.8 <= alike < 0.84
        apart, alike = edited(text[: len(text) // 2], 0.5)
        assert 0.5 <= alike < 0.6
        rows += [(3 * k, text), (3 * k + 1, near), (1000 + 2 * k, text[: len(text) // 2]), (1001 + 2 * k, apart)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in simhash.one_of_copies(docs).collect())
    assert got == sorted(i for i, _ in rows if i >= 1000 or i % 3 == 0)


@pytest.mark.parametrize(("most_prints", "most_shingles"), [(simhash.MOST_PRINTS, within.MOST_SHINGLES), (5, 400)])
def test_copy_groups_against_all_pairs(spark, prose, most_prints, most_shingles):
    """Families whose members drift apart step by step; with small limits keys and groups are dealt in blocks, whose results are the same."""
    rng, rows = random.Random(4), []
    for family in range(4):
        words = prose(90).split()
        for k in range(30):
            words[rng.randrange(len(words))] = f"new{family}x{k}"
            rows.append((family * 100 + k, " ".join(words)))
    rows += [(1000 + k, "a short line of six words") for k in range(30)] + [(2000, None), (2001, " "), (2002, ""), (2003, "one"), (2003, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [simhash.shingle_set(simhash.shingle_hashes((t or "").encode(), 5)) for _, t in rows]
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    want = components([(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])], range(len(rows)))
    first = {c: min(rows[k][0] for k in want if want[k] == c) for c in want.values()}
    assert 5 < len(first) < len(rows) / 2
    groups = simhash.copy_groups(docs, most_prints, most_shingles).groupBy("component").agg({"pick": "min"}).collect()
    assert sorted(r[1]["id"] for r in groups) == sorted(first.values())


def test_texts_of_kept_rows_are_shuffled_once(spark, prose):
    """The row that stays of a group is looked up and told from its repeats with one exchange of the texts."""
    docs = spark.createDataFrame([(k, prose(20)) for k in range(8)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.one_of_copies(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[plan.index("Window") : plan.index("SortMergeJoin")]
    assert "Exchange" not in above


def test_one_row_of_each_group_stays(spark, prose):
    """Repeated rows, rows without an id and an id with two texts: a row of each group stays, whatever its id, and no other goes."""
    a, b, c, d, e = (prose(60) for _ in range(5))
    rows = [(5, a), (5, a), (5, a), (None, b), (7, b), (None, c), (None, c), (9, d), (9, e), (8, d), (4, None), (None, ""), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], (r["text"] or "").strip()) for r in simhash.one_of_copies(docs).collect()]
    assert sorted(got, key=repr) == sorted([(5, a), (7, b), (None, c), (9, e), (8, d), (4, "")], key=repr)
    assert simhash.one_of_copies(docs).columns == docs.columns and simhash.one_of_copies(docs.limit(0)).count() == 0


def test_keys_are_joined_by_tries():
    """What ``against`` links, and whom it reaches, is what comparing all pairs gives; equal fingerprints included."""
    rng = np.random.default_rng(5)
    sizes = np.array([1, 2, 700, 40, 9])
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    values = base[rng.integers(0, 30, sizes.sum())]
    for _ in range(9):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, len(values)).astype(np.uint64)) * (rng.random(len(values)) < 0.8).astype(np.uint64)
    heads, of = simhash.segments(sizes)
    loads = simhash.Prints(values.view(np.int64).tolist(), np.ones(len(values)))
    for rows in (heads, np.flatnonzero(rng.random(len(values)) < 0.3), np.arange(len(values))):
        want = [(i, j) for i in rows for j in range(heads[of[i]], heads[of[i]] + sizes[of[i]]) if i != j and int(values[i] ^ values[j]).bit_count() <= simhash.COPY_BUDGET]
        got = [(int(i), int(j)) for some in within.near_pairs(loads, rows, heads[of[rows]], sizes[of[rows]]) for i, j in zip(*some, strict=True)]
        assert components(got, range(len(values))) == components(want, range(len(values)))
        assert {j for _, j in got} - set(rows.tolist()) == {j for _, j in want} - set(rows.tolist())


def test_candidates_come_from_the_join_of_fingerprints(spark):
    """Sets without a common key meet through the blocks of bits of their fingerprints; others, and empty sets, do not."""
    fp = 0x0123456789ABCDEF
    rows = [(10, fp, [], 9), (11, fp ^ 0xF, [], 9), (12, fp ^ 0x3F, [], 9), (13, fp, [], 9), (14, ~fp, [], 9), (0, 0, [], 0), (15, 1, [], 9)]
    nodes = spark.createDataFrame(rows, "node long, fp long, keys array<long>, size long")
    found = simhash.candidates(nodes).join(nodes, "node").select("node", "component").collect()
    assert sorted(r["node"] for r in found) == [10, 11, 12, 13] and len({r["component"] for r in found}) == 1

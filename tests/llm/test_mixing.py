import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from slatecast.llm import mixing


def highest_quotients(shares, blocks, limit):
    out = [0] * len(shares)
    for _ in range(min(blocks, sum(l for s, l in zip(shares, limit, strict=True) if s > 0))):
        best = max((k for k in range(len(shares)) if out[k] < limit[k] and shares[k] > 0), key=lambda k: (Fraction(shares[k]) / (2 * out[k] + 1), -k))
        out[best] += 1
    return out


def test_apportionment_gives_the_highest_quotients():
    rng = np.random.default_rng(1)
    for trial in range(200):
        n = int(rng.integers(1, 8))
        shares = rng.integers(0, 30, n) if trial % 2 else rng.integers(0, 100_000, n)
        limit = rng.integers(0, 40, n)
        blocks = int(rng.integers(0, 90))
        assert mixing.apportion(shares, blocks, limit).tolist() == highest_quotients(shares.tolist(), blocks, limit.tolist())


def test_ties_go_to_the_first():
    assert mixing.apportion(np.full(10_000, 5.0), 12_345, np.full(10_000, 3)).tolist() == [2] * 2345 + [1] * 7655


def test_small_sources_come_near_their_targets(spark):
    rows = [(0, "one two three", "a"), (1, "w " * 30, "b"), (2, "w " * 900, "c"), (3, "x " * 5, "d"), (4, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(docs).collect():
        assert abs(r["taken"] - r["target"]) <= mixing.BLOCK / 2 and r["taken"] <= 2 * r["size"], r


def test_targets_share_the_excess_again():
    assert mixing.targets([]) == []
    assert mixing.targets([0, 0]) == [0, 0]
    got = mixing.targets([100, 1000, 10, 5000])
    assert got[0] == 200 and got[2] == 20 and sum(got) == Fraction(3, 2) * 6110
    assert all(t <= 2 * s for t, s in zip(got, [100, 1000, 10, 5000], strict=True))
    assert got[1] == 2000  # weights 2 and 5 share what is left, and the first of them is full


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_of_odd_rows(odd, odd_rows, none):
    rows = mixing.mix(odd, block=4, shard_words=300).collect()
    assert len(rows) == len(odd_rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += words(r[1])
    names = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(names, mixing.targets([sizes[s] for s in names]), strict=True))
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(target[r["source"]]))
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.02 * float(target[s]) + 60
    again = mixing.mix(odd.repartition(7), block=4, shard_words=300).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixing.mix(none).count() == 0


def test_mixed_documents_hold_what_is_taken(odd, odd_rows, none):
    mixed = mixing.mixed_documents(odd, block=4)
    assert mixed.columns == odd.columns
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(odd, block=4).collect():
        want[r["doc_id"]] += r["taken"]
    texts = {r[0]: r[1] for r in odd_rows}
    for r in mixed.collect():
        got[r["doc_id"]] += words(r["text"])
        assert r["doc_id"] is None or (r["text"] or "") in (texts[r["doc_id"]] or "")
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}
    assert mixing.mixed_documents(none).count() == 0

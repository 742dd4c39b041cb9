import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slatecast.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(reference, prose):
    own = packing.Tokenizer(PATH)
    rng = random.Random(1)
    texts = ["", " ", "  a", "a  b", "a   b \n c", "x \n", "\n  y", "it's we'll <|endoftext|>", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b  <|endoftext|>\n<|endo", "日本 語　x", "a  b", prose(400)]
    texts += ["".join(rng.choice([" ", "a", "b1", "\n", "\t", "'s", ".", "é", " ", "　", "\r"]) for _ in range(rng.randint(0, 16))) for _ in range(1500)]
    assert [own(t).tolist() for t in texts] == [reference(t) for t in texts]


def test_forgetting_changes_nothing(reference, prose, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 40)
    own = packing.Tokenizer(PATH)
    for _ in range(20):
        text = prose(60)
        assert own(text).tolist() == reference(text)


@pytest.mark.parametrize("grain", [1, 4])
def test_each_placement_has_the_least_sum_of_squares(grain):
    """Over all open windows that have room and a new one, of which one with less room than a level is closed."""
    rng = np.random.default_rng(2)
    packer = packing.Packer(32, 1000, grain)
    for _ in range(400):
        size = int(rng.integers(1, 32))
        before, held = packer.levels.copy(), packer.counts.copy()

        def after(at, counts=before, size=size):
            new = counts.copy()
            new[at // grain] -= at > 0
            if at + size <= 32 - grain:
                new[(at + size) // grain] += 1
            return int((new**2).sum())

        best = min(after(h) for h in range(32 - size + 1) if h == 0 or held[h])
        packer.place(("d", 0, np.zeros(size, np.uint32), size), size)
        assert int((packer.levels**2).sum()) == best
        assert packer.levels.tolist() == np.bincount(np.arange(33) // grain, packer.counts).astype(int).tolist()


def test_few_windows_are_open_and_each_id_is_in_one_place():
    rng = np.random.default_rng(6)
    packer, ids, done = packing.Packer(64, 5, 2), np.arange(60_000, dtype=np.uint32), []
    at = 0
    while at < len(ids):
        size = int(min(rng.integers(1, 64), len(ids) - at))
        done += packer.add((at, 0, ids[at : at + size], size))
        assert packer.held == packer.counts.sum() <= 5 and packer.counts.tolist() == [len(x) for x in packer.open]
        at += size
    done += packer.close(0)
    sizes = [sum(len(p[2]) for p in pieces) for pieces in done]
    assert packer.held == 0 and all(n >= 63 or n & (n - 1) == 0 for n in sizes) and sum(n < 63 for n in sizes) < 7
    assert sorted(np.concatenate([p[2] for pieces in done for p in pieces]).tolist()) == ids.tolist()
    assert all(p[2][0] == p[0] + p[1] for pieces in done for p in pieces)


@pytest.mark.parametrize("n", [2500, 40_000])
def test_few_documents_are_cut_and_little_is_empty(n):
    """Remainders of any size, in a task of few and of many documents."""
    rng = np.random.default_rng(n)
    packer, done, ids = packing.Packer(), [], np.zeros(1024, np.uint32)
    sizes = rng.integers(1, 1024, n)
    for k, size in enumerate(sizes.tolist()):
        done += packer.add((k, 0, ids[:size], size))
    done += packer.close(0)
    cut = sum(len(p[2]) for pieces in done for p in pieces if len(p[2]) < p[3])
    lengths = [sum(len(p[2]) for p in pieces) for pieces in done]
    assert sum(lengths) == sizes.sum()
    assert cut < 0.02 * sizes.sum()
    assert sum(0 if m & (m - 1) == 0 else 1024 - m for m in lengths) < 0.006 * sizes.sum()


def test_documents_that_fit_with_no_other_are_dealt_out():
    """Where no two remainders fit together, no more windows are open and nothing is padded."""
    packer, done, ids = packing.Packer(64, 8, 2), [], np.arange(40, dtype=np.uint32)
    for k in range(101):
        done += packer.add((k, 0, ids, 40))
        assert packer.held <= 8
    done += packer.close(0)
    sizes = [sum(len(p[2]) for p in pieces) for pieces in done]
    assert sizes[:-1] == [64] * 63 and sizes[-1] == 8
    for k in range(101):
        own = sorted((p[1], p[2].tolist()) for pieces in done for p in pieces if p[0] == k)
        assert sum((x for _, x in own), []) == ids.tolist()


def test_pieces_of_odd_rows(odd, odd_rows, none, reference):
    rows = packing.pack(odd).collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        by_sequence[r["sequence_id"]].append(r)
        by_document[r["doc_id"], r["doc_tokens"]].append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.01 * sum(r["length"] for r in rows)
    want = defaultdict(list)
    for r in odd_rows:
        ids = [*reference(r[1] or ""), 0]
        want[r[0], len(ids)] += ids
    for key, pieces in by_document.items():
        ids = [i for r in pieces for i in np.frombuffer(r["ids"], "<u4").tolist()]
        assert sorted(ids) == sorted(want[key])
        if len(ids) == key[1]:
            assert [i for r in sorted(pieces, key=lambda r: r["start"]) for i in np.frombuffer(r["ids"], "<u4").tolist()] == want[key]
    assert by_document.keys() == want.keys()
    assert packing.pack(none).count() == 0

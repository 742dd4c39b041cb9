import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from slatecast.llm import queries, suffixes


def brute(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        out.append((len(t), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("alphabet", [1, 2, 3, 26])
def test_two_stage_order(alphabet):
    rng = np.random.default_rng(alphabet)
    for depth in (8, 16, 40):
        for _ in range(30):
            parts = []
            for _ in range(int(rng.integers(1, 7))):
                parts.append(rng.integers(97, 97 + alphabet, int(rng.integers(depth, depth + 70))).astype(np.uint8))
                if rng.random() < 0.5:
                    parts.append(np.concatenate([parts[0], parts[-1]]))
            data, size = np.concatenate(parts), np.array([len(p) for p in parts])
            end = np.cumsum(size)
            base, count = end - size, size - depth + 1
            order = suffixes.two_stage_order(data, base, count, end, depth)
            raw = data.tobytes()
            wanted = [p for b, n in zip(base, count, strict=True) for p in range(b, b + n)]
            keys = [raw[p : p + depth] for p in order]
            assert sorted(order.tolist()) == wanted and keys == sorted(keys)
            times = Counter(keys)
            flags = suffixes.twice_seen(data, base, count, end, depth)
            assert all(flags[p] == (times[raw[p : p + depth]] > 1) for p in wanted)


def check(docs, rows, length, gram, busy):
    got = sorted(repr((*r[:4], bytes(r[4]))) for r in suffixes.remove_repeats(docs, length, gram, busy).collect())
    texts = [(r[1] or "").encode() for r in rows]
    want = [repr((r[0], *x)) for r, x in zip(rows, brute(texts, length), strict=True)]
    same = got == sorted(want)  # apart, as the texts are too long to be shown
    assert same


@pytest.mark.parametrize("busy", [2048, 1])
def test_against_brute_force(odd, odd_rows, busy):
    check(odd, odd_rows, 64, 40, busy)


def test_shared_passages_and_crowds(spark, prose):
    rng = random.Random(8)
    passage, other = prose(60), prose(25)
    rows = [(k, prose(rng.randint(0, 30)) + " " + (passage if k % 2 else passage[rng.randint(0, 40) :]) + " " + prose(rng.randint(0, 30)) + (other * 3 if k % 7 == 0 else "")) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for busy in (2048, 5):
        check(docs, rows, 48, 32, busy)


def test_more_rows_than_a_slice(spark):
    """Batches are handled in slices, whose buffers begin further on."""
    rng = random.Random(3)
    shared = "".join(rng.choices("abcdefgh ", k=90))
    rows = [(k, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 70))) + (shared if k % 3 else shared[rng.randint(0, 30) :])) for k in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for busy in (2048, 300):
        check(docs, rows, 48, 32, busy)


def test_texts_longer_than_a_piece(spark, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    texts = [prose(900).encode() for _ in range(2)]
    texts.append(texts[0][1500:2600] + texts[1])
    found = suffixes.Anchors(48, 32).find(texts)
    assert [sum(found["more"][found["text"] == k] + 1) for k in range(3)] == [len(t) - 47 for t in texts]


def test_without_repeats_keeps_columns_and_clean_texts(odd, odd_rows):
    kept = suffixes.without_repeats(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    assert {42, 43, 44, 0, 1, 2} <= set(ids) and 48 not in ids and ids.count(None) == 2
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)


def test_empty_table(none):
    assert suffixes.remove_repeats(none).count() == 0
    assert suffixes.without_repeats(none).count() == 0


@pytest.mark.parametrize("busy", [2048, 5])
def test_two_lengths_at_once(spark, prose, odd, odd_rows, busy):
    """Each length by brute force, on copies, on passages that only the shorter one reaches, and on odd rows."""
    rng = random.Random(9)
    passage, short = prose(60), prose(40)[:58]
    rows = [(k, prose(rng.randint(0, 30)) + (passage[rng.randint(0, 40) :] if k % 2 else short) + prose(rng.randint(0, 20))) for k in range(50)]
    rows += [(50, rows[1][1]), (51, rows[2][1]), (52, rows[2][1]), (53, short * 3)]
    for docs, texts in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (odd, odd_rows)):
        got = sorted(repr((*r[:4], bytes(r["kept"]), r["rest"])) for r in suffixes.remove_repeats(docs, 64, 32, busy, passage=40).collect())
        raw = [(r[1] or "").encode() for r in texts]
        rest = [x[3].decode("utf-8", "ignore") for x in brute(raw, 40)]
        same = got == sorted(repr((r[0], *x, y)) for r, x, y in zip(texts, brute(raw, 64), rest, strict=True))
        assert same


def test_two_lengths_in_texts_longer_than_a_piece(prose, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    texts = [prose(900).encode(), prose(3).encode()[:30], prose(300).encode()[:1035], prose(300).encode()[:1050]]
    found = suffixes.Anchors((48, 40), 32).find(texts)
    for length in (40, 48):
        starts = [[] for _ in texts]
        for k, start, more, of in zip(*(found[c].tolist() for c in ("text", "start", "more", "length")), strict=True):
            if of == length:
                starts[k] += range(start, start + more + 1)
        assert [sorted(x) for x in starts] == [list(range(len(t) - length + 1)) for t in texts]


def test_passages_of_over_fifty_words(spark, prose, tmp_path):
    """A passage under 400 bytes that two texts share goes from ``text``, while the contract's columns leave it."""
    passage = " ".join(w[:5] for w in prose(400).split() if len(w) > 3)
    passage = " ".join(passage.split()[:55])
    assert 300 < len(passage.encode()) < 400
    texts = [f"{prose(40)} {passage} {prose(30)}", f"{prose(10)} {passage} {prose(90)}", prose(200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    done = {r["doc_id"]: r for r in queries.op9_suffixes(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        raw = text.encode()
        assert (done[k]["n_bytes"], done[k]["n_removed"], done[k]["n_spans"], done[k]["kept_sha256"]) == (len(raw), 0, 0, hashlib.sha256(raw).hexdigest())
        assert done[k]["kept_text"] == text
        assert done[k]["text"] == brute([t.encode() for t in texts], 256)[k][3].decode()
    assert passage not in done[0]["text"] + done[1]["text"] and done[2]["text"] == texts[2]


def test_equal_forms_are_not_cut_out_but_told_apart_by_digests(spark, prose):
    """Of a gram that stands in one form only, digests cross the network, and nothing is put in order."""
    text = prose(120)
    docs = spark.createDataFrame([(0, text), (1, text), (2, prose(80))], "doc_id long, text string")
    check(docs, docs.collect(), 64, 40, 2048)
    forms = [r for r in spark.createDataFrame([(1, 2, text.encode(), [(5 << 24 | 7, 1, 2, 64, False, a, False, True) for a in (True, False)])], "k1 long, k2 long, text binary, forms array<struct<place: long, gram: long, form: long, length: int, once: boolean, alone: boolean, busy: boolean, first: boolean>>").transform(suffixes._cut).collect()]
    part = text.encode()[5 : 5 + 64 + 7]
    assert [bytes(r["bytes"]) for r in sorted(forms, key=lambda r: not r["alone"])] == [hashlib.sha256(part).digest(), part]

import itertools
import random

import numpy as np

from slatecast.llm import quality, scan, toxicity
from slatecast.llm.labelled import training_rows


def test_words_and_slots():
    texts = [b"Ab, ab-AB x1", b"", "é é ÿ".encode(), b"longword longworm"]
    slots, counts = scan.distinct_slots(texts, 20)
    assert counts.tolist() == [2, 0, 2, 2] and len(slots) == 6
    _, counts = scan.distinct_slots(texts, 20, (4,))
    assert counts.tolist() == [2, 0, 2, 3]


def test_pieces_do_not_change_slots(monkeypatch, prose):
    texts = [prose(k * 7).encode() for k in range(30)]
    whole = scan.distinct_slots(texts, 16)
    monkeypatch.setattr(scan, "PIECE", 50)
    assert all((a == b).all() for a, b in zip(whole, scan.distinct_slots(texts, 16), strict=True))


def test_factorization_machine_learns_a_pair():
    """Either word alone is harmless, both together are not: no additive score can tell."""
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["insult"] * a + ["group"] * b + [f"w{rng.randrange(30)}" for _ in range(6)]).encode())
        labels.append(float(a and b))
    slots, counts = scan.distinct_slots(texts, toxicity.BITS)
    machine = toxicity.fit(slots, counts, np.array(labels))
    assert np.abs(machine.factors).max() > 0
    got = toxicity.sigmoid(machine.margins(*scan.distinct_slots([b"insult group w1", b"insult w1", b"group w1", b"w1"], toxicity.BITS, (), machine.weights != 0)))
    assert got[0] > 0.5 > max(got[1:])


def test_factorization_machine_learns_a_partner_that_alone_says_nothing():
    """"group" is in half of the toxic and half of the clean texts, yet makes "insult" toxic."""
    rng = random.Random(6)
    texts, labels = [], []
    for k in range(2400):
        words, toxic = ((["insult", "group"], 1), (["slur"], 1), (["insult"], 0), (["group"], 0), (["group"], 0), ([], 0))[k % 6]
        texts.append(" ".join([*words, *(f"w{rng.randrange(30)}" for _ in range(6))]).encode())
        labels.append(float(toxic))
    slots, counts = scan.distinct_slots(texts, toxicity.BITS)
    machine = toxicity.fit(slots, counts, np.array(labels))
    got = toxicity.sigmoid(machine.margins(*scan.distinct_slots([b"insult group w1", b"slur w1", b"insult w1", b"group w1"], toxicity.BITS, (), machine.weights != 0)))
    assert min(got[:2]) > 0.7 and max(got[2:]) < 0.3


def test_factorization_machine_learns_a_pair_of_which_neither_says_anything():
    """Toxic with one of two words but not with both: each word alone is in half of the toxic and half of the clean texts."""
    rng = random.Random(9)

    def some(n):
        texts, labels = [], []
        for _ in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            words = ["alpha"] * a + ["beta"] * b + [f"w{rng.randrange(600)}" for _ in range(40)]
            rng.shuffle(words)
            texts.append(" ".join(words).encode())
            labels.append(float(a != b))
        return texts, np.array(labels)

    texts, labels = some(3000)
    machine = toxicity.fit(*scan.distinct_slots(texts, toxicity.BITS), labels)
    texts, labels = some(800)
    slots, counts = scan.distinct_slots(texts, toxicity.BITS, (), machine.weights != 0)
    linear = toxicity.FactorizationMachine(machine.bias, machine.weights, machine.factors * 0)
    right = lambda m: ((m.margins(slots, counts) >= 0) == (labels > 0)).mean()
    assert right(machine) > 0.95 > 0.8 > right(linear)


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.FactorizationMachine(0.3, rng.normal(size=1 << toxicity.BITS).astype(np.float32), rng.normal(size=(1 << toxicity.BITS, 4)).astype(np.float32))
    slots, counts = np.array([5, 9, 12, 7]), np.array([3, 0, 1])
    want = [0.3 + sum(float(m.weights[s]) for s in part) + sum(float(m.factors[a].astype(float) @ m.factors[b].astype(float)) for a, b in itertools.combinations(part, 2)) for part in ([5, 9, 12], [], [7])]
    assert np.allclose(m.margins(slots, counts), want, atol=1e-5)


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(5)
    count = np.array([3, 1, 0, 5])
    lift, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    chance, pairs = quality.forward_backward(lift, moves, count)
    at, want, want_pairs = 0, [], np.zeros(4)
    for n in count:
        total, good = 0.0, np.zeros(n)
        both = np.zeros(4)
        for ys in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(lift[at + k] * y for k, y in enumerate(ys)) + sum(moves[a, b] for a, b in zip(ys, ys[1:], strict=False)))
            total += p
            good += p * np.array(ys)
            for a, b in zip(ys, ys[1:], strict=False):
                both[2 * a + b] += p
        want += list(good / total) if n else []
        want_pairs += both / total
        at += n
    assert np.allclose(chance, want) and np.allclose(pairs, want_pairs)


def test_field_learns_bad_lines(prose):
    rng = random.Random(2)
    texts, labels = [], []
    for k in range(400):
        bad = k % 3 == 0
        texts.append("\n".join("BUY!! NOW!! $$$ " * rng.randint(1, 5) if bad and rng.random() < 0.7 else prose(rng.randint(2, 20)) + "." for _ in range(rng.randint(2, 9))).encode())
        labels.append(float(not bad))
    field = quality.fit(quality.lines_of(texts), np.array(labels))
    scores = field.scores([f"{prose(9)}.\n{prose(12)}.".encode(), b"BUY!! NOW!! $$$\nBUY!! NOW!! $$$", b""])
    assert scores[0] > 0.7 > 0.3 > scores[1] and 0 <= scores[2] <= 1


def test_lines_are_told_apart_within_a_document(prose):
    """Only documents have labels, yet the good lines of a bad document are likelier to be good than its bad ones."""
    rng = random.Random(6)
    texts, labels = [], []
    for k in range(600):
        some = [prose(rng.randint(5, 15)) + "." for _ in range(6)]
        if k % 2:
            some[3:] = ["BUY!! NOW!! $$$ 100%"] * 3
        texts.append("\n".join(some).encode())
        labels.append(float(not k % 2))
    field = quality.fit(quality.lines_of(texts), np.array(labels))
    lines = quality.lines_of(texts[1:2])
    chance, _ = field.good(field.features(lines), lines.count)
    assert chance[:2].min() > 100 * chance[4:].max() and field.scores(texts[:2])[0] > 0.9 > 0.5 > field.scores(texts[:2])[1]


def test_slopes_against_differences():
    rng = np.random.default_rng(7)
    count, labels = np.array([3, 1, 5, 2]), np.array([1.0, 0.0, 0.0, 1.0])
    lift, moves, weight = rng.normal(size=11), rng.normal(size=(2, 2)), rng.integers(1, 9, 11).astype(float)
    weight /= np.repeat(np.add.reduceat(weight, [0, 3, 4, 9]), count)

    def cost(lift, moves):
        score = np.add.reduceat(quality.forward_backward(lift, moves, count)[0] * weight, [0, 3, 4, 9])
        return -np.mean(labels * np.log(score) + (1 - labels) * np.log(1 - score))

    slope, pair_slope = quality.slopes(lift, moves, count, weight, labels)
    near = lambda k, n: np.eye(n)[k] * 1e-5
    assert np.allclose(slope, [(cost(lift + near(k, 11), moves) - cost(lift - near(k, 11), moves)) / 2e-5 for k in range(11)], atol=1e-7)
    pairs = [near(k, 4).reshape(2, 2) for k in range(4)]
    assert np.allclose(pair_slope, [(cost(lift, moves + p) - cost(lift, moves - p)) / 2e-5 for p in pairs], atol=1e-7)


def judged(operator, docs, labels, n):
    rows = operator.judge(docs, labels).collect()
    assert len(rows) == n
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= operator.THRESHOLD) for r in rows)
    return rows


def test_odd_rows(odd, odd_rows, none, labels):
    import zlib

    for operator in (quality, toxicity):
        rows = judged(operator, odd, labels, len(odd_rows))
        assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        judged(operator, none, labels, 0)
        again = {(r["doc_id"], r["score"]) for r in judged(operator, odd, labels, len(odd_rows))}
        assert again == {(r["doc_id"], r["score"]) for r in rows}
        half = judged(operator, odd, labels.limit(0), len(odd_rows))
        assert len({r["score"] for r in half}) == 1


def test_drop_toxic_keeps_columns(odd, none, labels):
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    assert toxicity.drop_toxic(none, labels).count() == 0


def test_training_rows_leave_the_test_fold_out(odd, labels):
    import zlib

    rows = training_rows(odd, labels, "toxic", 20).collect()
    assert rows and all(zlib.crc32(str(r["_id"]).encode()) % 5 for r in rows) and all(r["label"] in (0, 1) for r in rows)

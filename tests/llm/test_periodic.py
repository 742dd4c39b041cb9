import hashlib
import random

from slatecast.llm import periodic


def brute_runs(words, least=6, times=4):
    """Every period's stretches, kept where no smaller period rules the same stretch."""
    n, spans = len(words), {}
    for p in range(1, n // times + 1):
        k = 0
        while k + p < n:
            if words[k] != words[k + p]:
                k += 1
                continue
            end = k
            while end + p < n and words[end] == words[end + p]:
                end += 1
            length = end + p - k
            if length >= max(least, times * p) and not any(all(words[x] == words[x + q] for x in range(k, k + length - q)) for q in range(1, p)):
                spans[k, p] = length
            k = end + 1
    return sorted((k, length, p) for (k, p), length in spans.items())


def test_runs_of_random_words():
    rng = random.Random(1)
    for trial in range(1500):
        letters = b"abcd"[: rng.randint(1, 4)]
        words = [bytes([rng.choice(letters)]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at, p = rng.randint(0, len(words)), rng.randint(1, 7)
            words[at:at] = [bytes([rng.choice(letters)]) for _ in range(p)] * rng.randint(2, 7)
        assert periodic.runs_of(words) == brute_runs(words), words
        if trial % 5 == 0:
            assert periodic.runs_of(words, 2, 2) == brute_runs(words, 2, 2), words


def test_equal_hashes_of_unequal_words():
    """Rolling hashes modulo a power of two agree on long Thue-Morse words and their opposites; the words decide."""
    morse = [bytes([97 + k.bit_count() % 2]) for k in range(4096)]
    opposite = [bytes([195 - w[0]]) for w in morse]
    ids = [w[0] - 97 for w in morse + opposite]
    agree = periodic.Agreement(ids)
    assert agree.same_hash(0, 4096, 4096) and agree.ahead(0, 4096) == 0
    assert agree.back(4096, 8192) == 0
    assert periodic.runs_of(morse + opposite) == []
    assert [r for r in periodic.runs_of((morse[:64] + opposite[:64]) * 5) if r[2] > 1] == [(0, 640, 128)]


def test_long_texts_take_time_in_proportion():
    rng = random.Random(2)
    word = [b"w%d" % rng.randint(0, 9) for _ in range(2000)]
    assert periodic.runs_of([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert (0, 200_000, 2000) in periodic.runs_of(word * 100)
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 100_000:
        a, b = b, b + a  # Fibonacci words are as full of runs as can be, none of them fourfold
    assert periodic.runs_of(b) == []


def test_query_against_brute_force(odd, odd_rows, none):
    found = periodic.periodic_runs(odd, change=periodic.planted)
    got = sorted(map(tuple, periodic.summarised(found).collect()), key=repr)
    want = []
    for doc_id, text, *_ in odd_rows:
        words = periodic.planted((text or "").encode().split(), doc_id)
        runs = brute_runs(words) if len(words) < 2000 else periodic.runs_of(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        kept = [w for k, w in enumerate(words) if not any(s + p <= k < s + length for s, length, p in runs)]
        digest = hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest()
        top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *top, digest, hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert got == sorted(want, key=repr)
    assert any(row[1] for row in got)
    assert periodic.summarised(periodic.periodic_runs(none)).count() == 0


def test_planting():
    words = [b"%d" % k for k in range(40)]
    changed = {k: periodic.planted(words, k) for k in [*range(200), None]}
    assert 5 < sum(x != words for x in changed.values()) < 50
    assert periodic.planted([], None) == [] and changed[None] == [words[k % 14] for k in range(40)]


def test_text_is_collapsed(spark):
    rows = [(1, "x no no no no no no no y", 1), (2, "ab cd ab cd ab cd ab cd ab", 1), (3, None, 1), (3, None, 1)]
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id int, text string, runs int")).collect()}
    assert got == {1: (9, [(1, 7, 1)], "x no y"), 2: (9, [(0, 9, 2)], "ab cd"), 3: (0, [], "")}

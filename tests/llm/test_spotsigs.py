import hashlib
import re

from slatecast.llm import spotsigs


def signatures(text, chain=3):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).strip().split(" ")
    content = [k for k, w in enumerate(words) if w not in spotsigs.COMMON]
    out = set()
    for n, k in enumerate(content):
        run = []
        j = k - 1
        while j >= 0 and words[j] in spotsigs.COMMON:
            run.insert(0, words[j])
            j -= 1
        if run:
            out.add((*run, *[words[c] for c in content[n : n + chain]]))
    if words[-1] in spotsigs.COMMON:  # common words with nothing after them
        run = []
        while len(run) < len(words) and words[-1 - len(run)] in spotsigs.COMMON:
            run.insert(0, words[-1 - len(run)])
        out.add((*run, ""))
    return out or {("whole", " ".join(words))}


def likeness(a, b):
    return len(a & b) / len(a | b)


def ordered(rows):
    """By descending id, null ids last, equal ids by text."""
    return sorted(rows, key=lambda r: (-r[0] if r[0] is not None else float("inf"), (r[1] or "").encode()))


def check(docs, rows):
    got = spotsigs.edited_likeness(docs).collect()
    rows = ordered(rows)
    want = []
    for k, r in enumerate(rows):
        text, after = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = signatures(text)
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(own, signatures(edited)), 9), round(likeness(own, signatures(after)), 9)))
    same = sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))) for r in got)
    assert same
    names = {}
    for r in got:
        names.setdefault(r["fingerprint"], r)
    assert len(names) == len({frozenset(signatures(r[1])) for r in rows})


def test_odd_rows(odd, odd_rows):
    check(odd, odd_rows)


def test_many_buckets(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_BYTES", 1500)
    check(odd, odd_rows)


def test_ranges_in_parts(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_BYTES", 1500)
    for ranges, parts in ((3, 2_000), (1, 2_000), (4, 3)):
        monkeypatch.setattr(spotsigs, "RANGES", ranges)
        monkeypatch.setattr(spotsigs, "PARTS", parts)
        check(odd, odd_rows)


def test_one_row_follows_itself(spark, none):
    rows = [(7, "The cat sat on the mat of a friend")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert spotsigs.edited_likeness(none).count() == 0


def test_plan_has_no_python(odd):
    plan = spotsigs.edited_likeness(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_similar_classes_against_all_pairs(spark, prose, odd_rows, none):
    rows = [(r[0], r[1]) for r in odd_rows]
    base = prose(150).split(" ")
    for k in range(12):
        words = list(base)
        for j in range(k):
            words[(11 * j + 3 * k) % 150] = f"new{j}"
        rows.append((100 + k, " ".join(words)))
    members, near = spotsigs.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(frozenset(signatures(text)), set()).add(i)
    want = {(i, min(ids)) for ids in sets.values() for i in ids}
    assert {tuple(r) for r in members.collect()} == want
    names = {min(ids): s for s, ids in sets.items()}
    pairs = {(a, b) for a in names for b in names if a < b and likeness(names[a], names[b]) >= 0.8}
    assert pairs and {(r["a"], r["b"]) for r in near.collect()} == pairs
    assert all(c.count() == 0 for c in spotsigs.similar_classes(none))


def test_links_against_all_pairs(spark, prose):
    """A row for each document: its class, and how many other classes are near it."""
    words = prose(120).split(" ")
    rows = [(k, " ".join([*words[: 120 - k], *(f"n{k}x{j}" for j in range(k))])) for k in range(0, 30, 6)] + [(50, " ".join(words)), (60, prose(90))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in spotsigs.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: frozenset(signatures(t)) for i, t in rows}
    names = {i: min(k for k in sets if sets[k] == sets[i]) for i in sets}
    want = {i: (names[i], sum(k != names[i] and likeness(sets[k], sets[i]) >= 0.8 for k in set(names.values()))) for i in sets}
    assert got == want and any(n for _, n in want.values())

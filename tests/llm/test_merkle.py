import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from slatecast.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The root of some nodes, and each one's siblings level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, place in enumerate(at):
            first = place - place % fanout
            paths[k].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + fanout])))
        at = [place // fanout for place in at]
        nodes = [sha(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for rows in groups.values():
        rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {name: tree([leaf(r) for r in groups[name]], fanout) for name in names}
    root, upper = tree([trees[name][0] for name in names], fanout)
    out = []
    for name, above in zip(names, upper, strict=True):
        for row, path in zip(groups[name], trees[name][1], strict=True):
            path = path + above
            changed = zlib.crc32(b"" if row["doc_id"] is None else str(row["doc_id"]).encode()) % 7 == 0
            node = leaf(row, int(changed))
            for left, right in path:
                node = sha(left, node, right)
            out.append((row["doc_id"], leaf(row), trees[name][0], root, sha(*(a + b for a, b in path)), node, node == root))
    return sorted(map(repr, out))


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("fanout", "block", "bucket"), [(2, 4, 3), (2, 1024, 4096), (3, 9, 2), (16, 8, 7)])
def test_manifest_against_brute_force(odd, fanout, block, bucket):
    made = merkle.manifest(odd, fanout=fanout, block=block, bucket=bucket, changed=merkle.tampered())
    got = sorted(repr(tuple(r)) for r in made.select(*COLUMNS).collect())
    assert got == brute([r.asDict() for r in odd.collect()], fanout)
    assert not all("False" in x for x in got) and any("False" in x for x in got)


def test_no_rows_and_one_row(none, odd):
    assert merkle.manifest(none).count() == 0
    one = merkle.manifest(odd.where("doc_id = 7")).collect()
    assert one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == one[0]["folded_root"] and one[0]["verified"] and one[0]["proof"] == ""


def test_ranks_of_crowded_and_clustered_keys(spark):
    """A third of the rows share one id; others lie close together far away from the rest."""
    ids = [5] * 400 + list(range(300)) + [1 << 40 | k for k in range(300)] + [-(1 << 62) + k * 7 for k in range(200)]
    rows = spark.createDataFrame([(f"g{k % 3 == 0}", i, k) for k, i in enumerate(ids)], "g string, id long, n long")
    keyed = rows.select("g", "id", F.concat(merkle.ordered_long(F.col("id")), merkle.ordered_long(F.col("n"))).alias("key"))
    got = merkle.radix_ranks(keyed.cache(), 8).collect()
    for g in ("gTrue", "gFalse"):
        mine = sorted((r["key"], r["rank"], r["total"], r["id"]) for r in got if r["g"] == g)
        assert [r[1] for r in mine] == list(range(len(mine))) and {r[2] for r in mine} == {len(mine)}
        assert [r[3] for r in mine] == sorted(r[3] for r in mine)
    assert len(got) == len(ids)


def test_plan_sends_no_text():
    """Texts are hashed where they are read: the only thing written is digests."""
    import inspect

    assert "text" not in inspect.getsource(merkle.Trie)


def test_query_has_an_oracle():
    from slatecast.llm import queries

    assert "op11_merkle" in queries.ORACLES

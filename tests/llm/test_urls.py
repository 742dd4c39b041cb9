import pytest

from slatecast.llm import urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[k:]
    j = next((j for j, c in enumerate(path) if c in "?#"), len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), path[:j]


def rule(url):
    host, path = split(url)
    fit = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


PAGES = [
    (1, "https://WWW.Example.com/en/a", '<link rel="canonical" href="https://good.example.net/en/1">'),
    (2, "http://x.org/a/b.html?q=1#top", "<LINK href='../../e' rel=canonical><meta http-equiv=refresh content=\"0; url='http://spam.net/es/1'\">"),
    (3, "http://spam.net/es/1", None),
    (4, "http://spam.net/en/1", '<link rel="canonical" href="//x.org/a/b.html?q=1">'),
    (5, "http://alone.org/fr/1", '<link rel="stylesheet" href="http://spam.net/es/1">'),
    (6, None, '<link rel="canonical" href="http://spam.net/es/1">'),
    (7, "no scheme", ""),
    (8, "http://b.com/en/#x", '<link rel="canonical" href="http://spam.net/es/1">'),
    (9, "HTTP://X.ORG/a/b.html?q=1", ""),
    (10, "http://c.org/k", '<link rel="canonical" href="/only/known">'),
    (11, "http://c.org/only/known#f", '<link data-x="1" rel="canonical" href="http://only-linked.net/fr/">'),
    (12, "http://c.org", "<link rel=canonical href=''>"),
    (12, "http://c.org", "<link rel=canonical href=''>"),
    (None, "http://example.com/en/", ""),
    (13, "x://a.net", ""),
    (14, "http://y.a.net/fr/?", ""),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, verdict string, _node string")


def test_rules_and_aliases(pages):
    rows = urls.judge(pages).collect()
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(PAGES)
    aliases = {2, 4, 9, 10, 11}  # linked with a blocked page, or with a blocked URL that only a link knows
    want = set()
    for i, url, _ in PAGES:
        text, verdict = rule(url)
        want.add((i, *split(url), text, verdict or ("block" if i in aliases else "allow")))
    assert got == want


def test_given_redirects(spark, pages):
    more = spark.createDataFrame([("http://alone.org/fr/1", "http://t.org/#k"), ("http://t.org/", "http://spam.net/es/1"), (None, "http://c.org")], "a string, b string")
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(pages, redirects=more).collect()}
    assert verdicts[5] == "block" and verdicts[12] == "allow"


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

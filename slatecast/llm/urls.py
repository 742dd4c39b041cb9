"""URL filters whose block decisions reach all aliases of a page.

Rules name a host, which covers its subdomains, and the beginning of a path; the longest that fits decides. Redirects and
canonical links make URLs equivalent; within a component of that relation a block reaches every URL that no rule of its
own decides. An explicit allow is such a rule, so it always stands.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatecast.llm.common import checkpoint
from slatecast.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The rules of the query (fixed values).
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(url: Column, rules: Iterable[Rule]) -> Column:
    """The text and verdict of the longest rule that fits, or null; of equally long ones an allow goes first."""
    host, path = host_of(url), path_of(url)
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", r.text)):
        found = F.when(rule.fits(host, path), F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def same_page(url: Column) -> Column:
    """A URL without its fragment, with scheme and host in lower case: what is fetched for it."""
    scheme = F.regexp_extract(url, "^([^:/?#]*)://", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(F.lower(scheme), F.lit("://"), host_of(url), path_of(url), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)))


def resolved(link: Column, base: Column) -> Column:
    """An absolute URL from a link on the page at ``base``; null for an empty link or one that leads nowhere."""
    site = F.regexp_extract(base, "^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([^:/?#]*://[^/?#]*(?:/[^?#]*)?/)", 1)
    link = F.trim(link)
    return (
        F.when((link == "") | link.isNull() | (site == ""), F.lit(None))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([^:/?#]*:)", 1), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), link))
        .otherwise(F.concat(F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder), link))
    )


_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    return F.concat(*[F.regexp_extract(tag, rf"(?i)\s{name}{_VALUE}", k) for k in (1, 2, 3)])


def page_links(pages: DataFrame) -> DataFrame:
    """``(a, b)``: each page and what its canonical links and refresh redirects name, as ``same_page`` writes them."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)(<(?:link|meta)\s[^>]*>)"), F.lit(1))
    some = pages.select("url", F.explode(F.filter(tags, lambda t: t.rlike("(?i)canonical|refresh"))).alias("tag"))
    tag = F.col("tag")
    canonical = F.when(tag.rlike("(?i)^<link") & _attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), _attribute(tag, "href"))
    refresh = F.when(tag.rlike("(?i)^<meta") & (F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh"), F.regexp_extract(_attribute(tag, "content"), r"(?i)^[^;,]*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1))
    return some.select(same_page(F.col("url")).alias("a"), same_page(resolved(F.coalesce(canonical, refresh), F.col("url"))).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url, html)``.

    ``redirects(a, b)`` may give further redirects between URLs. A URL that a rule fits has that rule's verdict; any other
    is blocked if an equivalent one is blocked by a rule, known as a page or from a link alone, else allowed. A null url
    has empty host and path and no aliases; null html has no links; repeated rows each come out; other columns are
    ignored; an empty table gives an empty table.
    """
    rules = tuple(rules)
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(same_page(F.col("a")).alias("a"), same_page(F.col("b")).alias("b")))
    groups = connected_components(links)
    # a component is blocked if one of its URLs is; only components with links are looked at
    blocked = groups.where(matched(F.col("node"), rules)["verdict"] == "block").select("component").distinct()
    aliases = checkpoint(groups.join(blocked, "component", "left_semi").select(F.col("node").alias("_node")))
    url = F.col("url")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), matched(url, rules).alias("own"), same_page(url).alias("_node"))
    joined = own.join(aliases.withColumn("_blocked", F.lit(True)), "_node", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


#: The same in DuckDB's SQL, over the table ``pages``.
ORACLE = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\s[^>]*>')) AS tag FROM u),
named AS (
  SELECT url, CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s>]*)', 1)
    WHEN regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*([^"''\s>]*)', 1) END AS link
  FROM tags WHERE regexp_matches(tag, '(?i)canonical|refresh')),
links AS (
  SELECT regexp_extract(url, '^[^#]*') AS a, regexp_extract(CASE
    WHEN link LIKE '%://%' THEN link
    WHEN link LIKE '//%' THEN regexp_extract(url, '^[^:/?#]*:') || link
    WHEN link LIKE '/%' THEN regexp_extract(url, '^[^:/?#]*://[^/?#]*') || link
    ELSE regexp_extract(url, '^[^:/?#]*://[^/?#]*(?:/[^?#]*)?/') || link END, '^[^#]*') AS b
  FROM named WHERE link <> '' AND url LIKE '%://%'),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
hit AS (
  SELECT a FROM (SELECT DISTINCT a, translate(regexp_extract(a, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, regexp_extract(a, '://[^/?#]*([^?#]*)', 1) AS p FROM both_ways)
  WHERE NOT ((h = 'www.example.com' OR h LIKE '%.www.example.com') AND p LIKE '/en/%')
    AND (((h = 'example.com' OR h LIKE '%.example.com') AND p LIKE '/en/%') OR ((h = 'net' OR h LIKE '%.net') AND (p LIKE '/es/%' OR p LIKE '/fr/%')))),
reached AS (SELECT a FROM hit UNION SELECT e.b FROM reached r JOIN both_ways e ON e.a = r.a),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_extract(url, '^[^#]*') IN (SELECT a FROM reached) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

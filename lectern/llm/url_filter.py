"""URL rules whose block decisions reach the aliases of a page, with DataFrame functions only.

Addresses that redirect to one another or name one another as canonical are
aliases. Links come from a page's HTML (``<link rel=canonical>`` and ``<meta
http-equiv=refresh>``) and, where there is one, from a table of redirects. The
connected components of these links, found by distributed stars, carry the
decision of a blocking rule from each address to all of its aliases. A page whose
own address fits a rule keeps that rule's decision, so an explicit allow always
takes precedence over a block that comes from an alias.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, numbered, written
from .components import components

#: (verdict, host and path): a rule fits its host and all subdomains if the path of the address starts with its own.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_QUOTED = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_LINK = r"(?i)<link\s[^>]*>"
_CANONICAL = r"""(?i)\srel\s*=\s*["']?([^"'>]*\s)?canonical[\s"'/>]"""
_HREF = r"(?i)\shref" + _QUOTED
_META = r"(?i)<meta\s[^>]*>"
_REFRESH = r"""(?i)\shttp-equiv\s*=\s*["']?refresh[\s"'/>]"""
_TARGET = r"""(?i)\scontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'>\s]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """The host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """The path after the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """128 bits of an address: host, path and query. Scheme and fragment do not tell addresses apart. Null where there is no host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.md5(F.concat(host_of(url), F.lit(" "), path_of(url), query)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of an address: the longest rule that fits, of equally long ones an allowing one; null where none fits."""
    best = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))

    def first(of) -> Column:
        out = F.lit(None).cast("string")
        for verdict, rule in reversed(best):
            at, _, below = rule.partition("/")
            fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
            out = F.when(fits, F.lit(of(verdict, rule))).otherwise(out)
        return out

    return first(lambda _, rule: rule), first(lambda verdict, _: verdict)


def _absolute(url: Column, link: Column) -> Column:
    """A link as an address: whole, without scheme, from the root, by its query, or beside the page (dot segments stay). Null for other schemes."""
    link = F.trim(F.replace(F.regexp_replace(link, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")))
    base = F.concat(F.lit("x://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "^(.*/)?", 0)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, path_of(url), link))
        .when(link.rlike("^(#|$)") | link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), link))
    )


def links_of(html: Column) -> Column:
    """The targets of canonical links and of refreshing redirects in a whole page, as they are written."""
    tags = lambda tag, which: F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(which))
    canonical = F.transform(tags(_LINK, _CANONICAL), lambda t: F.regexp_extract(t, _HREF, 1))
    refresh = F.transform(tags(_META, _REFRESH), lambda t: F.regexp_extract(t, _TARGET, 1))
    none = F.array().cast("array<string>")
    found = F.when(html.rlike(r"(?i)canonical|http-equiv"), F.concat(canonical, refresh)).otherwise(none)
    return F.coalesce(F.filter(found, lambda x: x != ""), none)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of ``pages``: key, host, path, rule (null where none fits), verdict, aliased (blocked through an alias).

    The verdict is the rule's; without a rule a page is blocked if any address
    of its component fits a blocking rule best, whether there is a page at that
    address or not, else allowed. ``redirects`` (two columns, from and to, whole
    URLs) adds links to those of the pages. Rules become one expression, so
    there should be at most some hundred. Null or broken URLs have empty host
    and path, no rule and no aliases, and are allowed; null HTML has no links;
    repeated rows are judged alike; an empty table gives an empty one; extra
    columns are not read.

    HTML is read once. What is written and joined is addresses of 128 bits, and
    after components only blocked addresses: rows of an address that many pages
    share meet a broadcast row.
    """
    plain, _ = numbered(pages.select(key, url, html))
    host, path = host_of(F.col("c1")), path_of(F.col("c1"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    target = lambda link: F.struct(address_of(link).alias("to"), rule_of(host_of(link), path_of(link), rules)[1].alias("verdict"))
    rows = written(
        plain.select(F.monotonically_increasing_id().alias("row"), "c0", host.alias("host"), path.alias("path"), address_of(F.col("c1")).alias("address"), F.transform(links_of(F.col("c2")), lambda x: _absolute(F.col("c1"), x)).alias("links"))
        .select("row", "c0", "host", "path", "address", rule.alias("rule"), verdict.alias("verdict"), F.transform("links", target).alias("targets")),
        "pages",
    )
    linked = rows.where("size(targets) > 0 and address is not null").select("address", "verdict", F.explode("targets").alias("t"))
    ends = linked.select(F.col("address").alias("u"), F.col("t.to").alias("v"), F.col("verdict").alias("a"), F.col("t.verdict").alias("b"))
    if redirects is not None:
        pairs, _ = numbered(redirects.select(*redirects.columns[:2]))
        u, v = F.col("c0"), F.col("c1")
        ends = ends.unionByName(pairs.select(address_of(u).alias("u"), address_of(v).alias("v"), rule_of(host_of(u), path_of(u), rules)[1].alias("a"), rule_of(host_of(v), path_of(v), rules)[1].alias("b")))
    edges = written(ends.where("u is not null and v is not null and u <> v").distinct(), "links")
    out = F.coalesce("verdict", F.when(F.col("aliased"), "block").otherwise("allow"))
    final = lambda found: found.select(F.col("c0").alias(key), "host", "path", "rule", out.alias("verdict"), "aliased")
    if not edges.head(1):
        return final(rows.withColumn("aliased", F.lit(False)))
    stars = components(edges.select("u", "v"))
    known = edges.select(F.col("u").alias("node"), F.col("a").alias("verdict")).union(edges.select("v", "b")).where("verdict = 'block'").select("node").distinct()
    blocked = stars.join(stars.join(known, "node", "left_semi").select("component").distinct(), "component", "left_semi").select(F.col("node").alias("address"))
    open_ = rows.where("verdict is null and address is not null").select("row", "address")
    few = open_.groupBy("address").agg(F.count(F.lit(1)).alias("n")).join(blocked, "address")
    hit = meet(open_, written(few, "blocked"), ["address"], "n", open_.count()).select("row", F.lit(True).alias("aliased"))
    return final(rows.join(hit, "row", "left").withColumn("aliased", F.coalesce("aliased", F.lit(False))))

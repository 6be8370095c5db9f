import random
import re

from lectern.llm import url_filter

PAGES = "page_id long, url string, html string"


def judged(spark, rows, **more):
    return {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, PAGES), **more).collect()}


def page(link):
    return f'<html><head><LINK href="{link}" rel="canonical"></head><body>text</body></html>'


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://A.Example.NET/de/x?y=/en/#z", ""),
        (2, "https://b.example.net/en/7", ""),
        (3, "https://notexample.net", ""),
        (4, "https://x.example.org/fr/1#top", None),
        (5, "//example.net/de/", ""),
        (6, None, ""),
        (7, "https://example.com/de/", ""),
        (8, "https://Ünet/é", ""),
        (9, "https://internet/", ""),
        (10, "a://net?q", ""),
        (11, "https://net/", ""),
    ]
    got = {k: (r.host, r.path, r.rule, r.verdict) for k, r in judged(spark, rows).items()}
    assert got == {
        1: ("a.example.net", "/de/x", "net/", "block"),
        2: ("b.example.net", "/en/7", "example.net/en/", "allow"),
        3: ("notexample.net", "", None, "allow"),
        4: ("x.example.org", "/fr/1", "org/fr/", "allow"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("example.com", "/de/", "example.com/de/", "block"),
        8: ("Ünet", "/é", None, "allow"),
        9: ("internet", "/", None, "allow"),
        10: ("net", "", None, "allow"),
        11: ("net", "/", "net/", "block"),
    }


def test_blocks_reach_aliases_and_an_explicit_allow_stays(spark):
    refresh = '<meta http-equiv="refresh" content="0; url=/en/end?a=1&amp;b=2">'
    rows = [
        (1, "https://one.org/en/a", page("https://two.org/en/b")),  # two links away from a blocked address that is no page
        (2, "http://two.org/en/b#x", page("//three.example.net/es/c")),
        (3, "https://four.org/fr/d", page("https://two.org/en/b")),  # an alias of it, but allowed by a rule
        (4, "https://five.org/en/e", page("https://six.example.net/en/f")),  # allowed target
        (5, "https://seven.org/en/g", refresh),
        (6, "https://seven.org/en/end?a=1&b=2", ""),
        (7, "https://eight.org/en/h", '<a href="https://x.net/">canonical</a><link rel="stylesheet" href="https://x.net/a.css">'),
        (8, "https://nine.org/en/i", page("mailto:a@b.net") + page("#top") + page("")),
        (9, "https://ten.org/en/j", "<link rel='nofollow canonical' href=k>"),
        (10, "https://ten.org/en/k", ""),
    ]
    moved = spark.createDataFrame([("https://seven.org/en/end?a=1&b=2", "https://z.net/"), ("https://ten.org/en/k", None), (None, None)], "src string, dst string")
    got = {k: (r.verdict, r.aliased) for k, r in judged(spark, rows, redirects=moved).items()}
    assert got == {1: ("block", True), 2: ("block", True), 3: ("allow", False), 4: ("allow", False), 5: ("block", True), 6: ("block", True), 7: ("allow", False), 8: ("allow", False), 9: ("allow", False), 10: ("allow", False)}


def test_random_links_against_a_search(spark):
    rng = random.Random(3)
    hosts = ["a.org", "b.org", "c.example.net", "d.com", "example.com"]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{i}" for i in range(300)]
    rows = [(i, u, page(rng.choice(urls)) if rng.random() < 0.6 else "") for i, u in enumerate(urls)]
    rows += [(1000 + i, urls[7], page(urls[8])) for i in range(400)]  # one address has most rows
    near = {}
    for _, u, h in rows:
        for target in re.findall('href="([^"]+)"', h):
            near.setdefault(u, set()).add(target)
            near.setdefault(target, set()).add(u)

    def own(u):
        host, path = re.match("https://([^/]*)(.*)", u).groups()
        for verdict, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
            at, below = rule.split("/", 1)
            if ("." + host).endswith("." + at) and path.startswith("/" + below):
                return verdict

    def expected(u):
        if own(u):
            return own(u)
        seen, todo = {u}, [u]
        while todo:
            for v in near.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return "block" if any(own(v) == "block" for v in seen) else "allow"

    got = judged(spark, rows)
    assert len(got) == len(rows) and all(got[k].verdict == expected(u) for k, u, _ in rows)
    assert any(r.aliased for r in got.values())


def test_repeats_clashing_columns_long_pages_and_empty_tables(spark):
    long = page("https://x.net/") + "<link rel=x>" * 100_000
    rows = [(1, "https://a.org/en/", long, "h", "b"), (1, "https://a.org/en/", long, "h", "b"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, PAGES + ", host string, verdict string")
    got = [(r.page_id, r.host, r.verdict) for r in url_filter.judge(df).collect()]
    assert sorted(got, key=str) == [(1, "a.org", "block"), (1, "a.org", "block"), (None, "", "allow")]
    assert url_filter.judge(spark.createDataFrame([], PAGES)).collect() == []

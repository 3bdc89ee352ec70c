import random

from pyspark.sql import functions as F

from kindred.llm.url_filter import RULES, build_cascade, is_listed, judge


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for rule, verdict in RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http:///x", "http://a.net", "http://a.net/", "HTTP://A.Example.NET/en/x?y=/de/#z", "http://example.net/en", "http://notexample.net/en/",
    "https://example.com/de/1", "https://www.example.com/de/1#a://b", "https://example.com/DE/1", "http://x.org/fr/", "http://org/fr/a", "http://fororg/fr/", "http://net/", "http://a..net/x",
    "http://a.net?x=/", "http://a.net#/", "ftp://é.NET/ü", "http://.net/", "x://y://z.net/", "http://" + "a." * 2000 + "net/q", "http://a b.net/\n/x", "http://u:p@a.net:80/x",
]


def test_urls(spark):
    rows = spark.createDataFrame([(i, u, "c") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string")
    got = judge(rows).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url), r.url
    assert judge(rows.limit(0)).collect() == []


def test_longest_rule_wins(spark):
    rules = [("b.com/", "block"), ("b.com/ok/", "allow"), ("a.b.com/ok/", "block")]
    rows = spark.createDataFrame([("http://a.b.com/ok/1",), ("http://c.b.com/ok/1",), ("http://b.com/x",)], "url string")
    assert {r.url: r.rule for r in judge(rows, rules).collect()} == {"http://a.b.com/ok/1": "a.b.com/ok/", "http://c.b.com/ok/1": "b.com/ok/", "http://b.com/x": "b.com/"}


def test_cascade_is_exact(spark):
    r = random.Random(4)
    keys = [f"k{r.randrange(10**9)}" for _ in range(20_000)]
    listed = set(keys[:3000])
    every = spark.createDataFrame([(k,) for k in keys], "key string")
    levels = build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), every)
    assert len(levels) > 1  # some keys were mistaken at first
    wrong = every.select("key", is_listed(levels, F.col("key")).alias("y")).collect()
    assert all(x.y == (x.key in listed) for x in wrong)
    assert build_cascade(every.limit(0), every) == []
    assert not any(x.y for x in every.select(is_listed([], F.col("key")).alias("y")).collect())


def test_names_and_long_hosts(spark):
    long = ["http://" + "a." * 500_000 + "net/q", "http://" + "a" * 2_000_000 + "/x", "http://example.net/en/" + "x" * 2_000_000]
    rows = spark.createDataFrame([(u, 1, 2, 3) for u in long], "url string, __mine int, `a.b` int, keys int")
    got = judge(rows)
    assert got.columns == ["url", "__mine", "a.b", "keys", "host", "path", "rule", "verdict"]
    assert [(r.rule, r.verdict) for r in got.collect()] == [("net/", "block"), (None, "allow"), ("example.net/en/", "allow")]

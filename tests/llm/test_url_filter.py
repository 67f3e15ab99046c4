import re

from strandflow.llm import url_filter

SITES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.Example.NET/en/x?y#z", "http://a.example.net/EN/x",
    "http://xexample.com/de/", "http://b.example.com/de/1", "http://org/fr/", "http://example.org/fr", "http://example.org?q=/fr/",
    "ftp://adult-x.example.com/en/1", "http://x.example.com/adult.", "http://xxx.example.org/", "http://a.xxx/b", "://EXAMPLE.net/en/",
    "http://é.NET/ä://x", "http://a.b/download/x/y.exe", "http://a.b/download/x/y.exe?z", "http://ads.site.com/img/banners/1",
    "http://www.example.org/fr/1\n2", "http://casinos.com/", "http://my-casino.com/" + "p/" * 5000,
]


#: The pattern rules as plainly as can be.
PLAIN = {
    **{f"{w}-host": rf"^([^/]*[.-])?{w}[.-]" for w in ("adult", "casino", "porn", "phishing", "gambling")},
    "xxx-host": r"^([^/]*[.-])?xxx([.-][^/]*)?/",
    "download-exe": r"(?s)/download/.*[^/]\.exe\Z",
    "ad-server": r"^([^/]*\.)?ads\.[^/]*/banners/",
}
TARGETS = [
    "adult.com/", "my-adult.com/", "adults.com", "xxx", "xxx/", "a.xxx/b", "xxxx/", "xxx.com", "a-xxx-b.com/x", "x.com/download/.exe", "x.com/download/a/b.exe",
    "x.com/download/a.exe/download/", "x.com/download/b/download/a.exe", "ads.a.com/banners/", "x.ads.a.com/banners/1", "ads.a.com/x/banners/", "bads.a.com/banners/",
    "ads/banners/", "gambling.x/", "x.com/download/a\n.exe", "x.com/download/a.exe\n",
]


def test_patterns_against_plain_ones(spark):
    assert {r.name for r in url_filter.PATTERN_RULES} == PLAIN.keys()
    pages = spark.createDataFrame([(i, f"http://{t}") for i, t in enumerate(TARGETS)], "page_id long, url string")
    got = {r.page_id: r.pattern_rule for r in url_filter.judge(pages, url_filter.PATTERN_RULES).collect()}
    assert got == {i: min((n for n, p in PLAIN.items() if re.search(p, t)), default=None) for i, t in enumerate(TARGETS)}


def test_very_long_urls(spark):
    urls = [
        "http://a.b/download/" + "s/" * 1_000_000 + "y.exe", "http://a.b/download/" * 50_000, "http://" + "ads." * 250_000 + "x", "http://" + "xxx." * 250_000,
        "http://" + "adult-x." * 100_000 + "net", "http://a.com/" + "download/exe/" * 50_000,
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule, r.pattern_rule) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("block", None, "download-exe") and got[1] == got[2] == ("allow", None, None)
    assert got[4] == ("block", None, "adult-host") and got[5] == ("allow", None, None)


def test_rules_as_a_table(spark):
    rules = [(f"r{i}", "block", rf"^site{i}\.", [f"site{i}", "com"], False) for i in range(5000)] + [("none", "block", "x", [], False), ("null", "block", "x", None, False)]
    pages = spark.createDataFrame([(i, f"http://site{i}.com/x") for i in (3, 4999, 5000)], "page_id long, url string")
    got = {r.page_id: r.pattern_rule for r in url_filter.judge(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA)).collect()}
    assert got == {3: "r3", 4999: "r4999", 5000: None}
    assert {r.verdict for r in url_filter.judge(pages, ()).collect()} == {"allow"}


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(re.search(p, host + path) for p in PLAIN.values())
    return host, path, None, "block" if bad else "allow"


def test_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(3, URLS[9], "x", "y")] * 3 + [(None, URLS[6], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, token string")
    out = url_filter.judge(pages).collect()
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out), key=str)
    assert got == sorted(((i, *brute(u)) for i, u, *_ in rows), key=str)


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rarest_token(spark):
    tokens = spark.createDataFrame([("example",)] * 9 + [("de",)] * 3 + [("com",)] * 9, "token string")
    index = {r.rule: r.token for r in url_filter.rule_index(url_filter.rule_table(spark, url_filter.SITE_RULES), tokens).collect()}
    assert index["example.com/de/"] == "de" and index["net/"] == "net"

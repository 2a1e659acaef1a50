import hashlib

from rankloom.llm.op9_url_filter import RULES
from rankloom.llm.url_filter import hashed_rules, judge

URLS = [
    "http://Blog.Example.ORG/en/123?q#f", "https://example.org/es/", "https://example.org", "http://example.org?x", "ftp://a.b.com/de/x", "x://com/fr/",
    "http://notexample.org/es/1", "http://example.org:80/es/1", "no scheme", "", None, "a://b://c/d", "http://example.org/EN/1", "http://.org/", "://org/#a",
    "http://example.org/en/1\nx", "http://x.com/fr", "http://" + "a." * 3000 + "com/de/" + "p" * 50_000,
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def judged(spark, urls, rules):
    df = spark.createDataFrame([(u, "x") for u in urls], "url string, host string")
    got = judge(df, "url", spark.createDataFrame(rules, "host string, path string, action string"))
    assert got.columns == ["url", "host", "path", "rule", "verdict"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_as_brute_force(spark):
    rules = [*RULES, ("com", "", "block"), ("example.org", "/en/", "block"), ("org", "/en/", "allow"), ("org", "/en/", "block")]
    for some in (RULES, rules, [("", "", "block")], []):
        want = sorted(((u, *brute(u, some)) for u in URLS + URLS[:2]), key=repr)
        assert judged(spark, URLS + URLS[:2], some) == want


def test_nulls_in_rules_and_no_urls(spark):
    assert judged(spark, ["http://a.com/x"], [("com", None, "block"), ("a.com", "/x", None), (None, None, "allow")])[0][3:] == ("com", "block")
    assert judged(spark, [], RULES) == []


def test_rules_meet_by_short_and_full_digest(spark):
    row = hashed_rules(spark.createDataFrame([("Org", "/", "allow")], "host string, path string, action string")).first()
    full = hashlib.sha256(b"org/").hexdigest()
    assert (row._rule, row._digest, row._short) == ("org/", full, full[:8])

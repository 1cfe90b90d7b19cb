"""Cutting and rules against plain Python, and the model on unseen hosts."""

import re

from notemill.llm import urls


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    best = ""
    for _, r in urls.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(r) > len(best):
            best = r
    return best or None


def test_against_plain_python(spark):
    given = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/4?x=/fr/", "https://a.org", "https://a.org/", "https://a.org?x/",
             "https://a.b.example.org/en/19#t", "https://example.org/en/2", "http://notexample.org/es/1", "http://x.com/fr/8", "http://com/de/", "http://x.com/de",
             "http://x.net/a://b/c", "a://b://c/d", "http://ÉCOLE.org/é\nx", "http://x.com:80/fr/", "http://x.org/" + "a" * 100000, "http://x.com/FR/1"]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate([*given, given[4]])], "page_id long, url string, html string, host int")
    out = {r["page_id"]: r for r in urls.filter_urls(df).collect()}
    verdicts = {r: v for v, r in urls.RULES}
    for i, u in enumerate([*given, given[4]]):
        host, path = cut(u)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule(host, path)), u
        assert out[i]["verdict"] == verdicts.get(rule(host, path), out[i]["verdict"])
    assert out[0]["verdict"] == out[1]["verdict"] == "allow"
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_model_on_unseen_urls(spark):
    bad = ["http://mega-casino.test/en/3", "https://www.pills-cheap.test/es/9", "http://bets-free.test/x", "https://m.spam-links.test/2", "http://adult-zone.test/en/4"]
    good = ["http://thatinon.test/en/3", "https://www.ththing.test/es/9", "http://blog.erand.test/x", "https://m.station.test/2", "http://thertion.test/en/4"]
    df = spark.createDataFrame([(u,) for u in bad + good], "url string")
    out = {r["url"]: r["verdict"] for r in urls.filter_urls(df).collect()}
    assert [out[u] for u in bad] == ["block"] * 5 and [out[u] for u in good] == ["allow"] * 5
    assert {r["verdict"] for r in urls.filter_urls(df, labelled=()).collect()} == {"allow"}

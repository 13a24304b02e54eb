import re

from mirrorframe.llm import urls
from mirrorframe.llm.queries import HOST_RULES

URLS = [None, "", "no scheme/net/", "http://", "http://NET/", "http://net", "https://a.net/x", "https://a.NET/x?y#z", "ftp://example.net/en/1", "http://www.example.net/en/", "http://notexample.net/en/",
        "http://example.net/EN/", "http://example.com/de/3", "http://xexample.com/de/3", "http://a.org/fr/", "http://org/fr", "http://a.org#/fr/", "http://a.net:80/q", "x://y://a.net/", "http://a.com/wp-login.php", "http://exampleXnet/en/"]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(r, v) for r, v in HOST_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "block" if path.endswith("/wp-login.php") else "allow")
    return host, path, rule, verdict


def test_verdicts_and_repeats(spark):
    rules = [urls.host_path_rule(*r) for r in HOST_RULES] + [urls.pattern_rule(r"/wp-login\.php$", "block", ["wp", "login", "php"])]
    rows = [(i, u, "kept", "old") for i, u in enumerate(URLS * 3)] + [(0, None, "kept", "old")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, tokens STRING, rule STRING").repartition(3)
    got = urls.filter_urls(pages, urls.rule_table(spark, rules))
    assert got.columns == ["page_id", "url", "tokens", "host", "path", "rule", "verdict"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(r["url"]), r


def test_rules_without_tokens_ties_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (2, "http://a.b/d")], "page_id LONG, url STRING")
    rules = urls.rule_table(spark, [urls.pattern_rule("c$", "block", []), urls.pattern_rule("d$", "allow", ["d"]), urls.pattern_rule("b/", "block", ["b"])])
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, rules).collect()} == {1: "block", 2: "block"}  # equal lengths: the smaller text
    assert {r["verdict"] for r in urls.filter_urls(pages, rules.limit(0), default="allow").collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), rules).count() == 0


def test_large_rule_lists_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "RULES_TO_BROADCAST", 1)
    rules = [urls.host_path_rule(*r) for r in HOST_RULES]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS[:-2])], "page_id LONG, url STRING")
    for r in urls.filter_urls(pages, urls.rule_table(spark, rules)).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(r["url"])

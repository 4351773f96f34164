"""Fetching: addresses, redirect chains against a plain walk, robots, sitemaps."""

import random
from urllib.parse import urljoin

import pytest
from pagewright.operators import fetch as FE
from pyspark.sql import functions as F

RESPONSES = "url string, status int, content_type string, content_length long, location string, body string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_addresses_are_resolved_as_by_the_library(spark):
    bases = ["https://a.example/b/c/d?q=1#f", "http://a.example", "https://a.example/b/", "https://a.example:8080/x"]
    hrefs = ["g", "./g", "g/", "/g", "//h.example/x", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "g/./h/../i", "https://h.example/z", "mailto:x@y.example", "g;x=1/../y"]
    rows = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(rows, "b string, h string").select("b", "h", FE.key(FE.absolute(F.col("h"), F.col("b"))).alias("x"))
    for r in df.collect():
        want = urljoin(r["b"], r["h"]).split("#")[0]
        head, sep, rest = want.partition("://")
        if sep and "/" not in rest.split("?")[0]:
            want = f"{head}://{rest.replace('?', '/?') if '?' in rest else rest + '/'}"
        assert r["x"] == want, (r["b"], r["h"])


@pytest.mark.parametrize("url,want", [
    ("HTTPS://A.Example:443/x#y", "https://a.example/x"), ("http://a.example:80", "http://a.example/"), ("http://a.example:8080/?q", "http://a.example:8080/?q"), ("https://a.example/x/../y/./z/..", "https://a.example/y/"),
    ("https://a.example/%2E%2e/x", "https://a.example/x"), ("http://", None), ("http://a b.example/", None), ("http://a.example:99999/", None), ("", None), (None, None), ("mailto:x@y", "mailto:x@y"), ("http://u:p@a.example/", "http://u:p@a.example/"),
])
def test_one_spelling(spark, url, want):
    assert one(spark, FE.key(F.lit(url).cast("string"))) == want


def walked(url, known, most):
    """A plain walk over responses: chain, final address and error."""
    chain, at = [url], url
    for _ in range(most + 1):
        if "127.0.0.1" in at:
            return chain, at, "blocked_url"
        status, kind, _, location, _ = known.get(at, (None,) * 5)
        if status is None:
            return chain, at, "fetch_failed"
        if 300 <= status < 400:
            if not location:
                return chain, at, "fetch_failed"
            at = urljoin(at, location)
            chain.append(at)
            continue
        if not 200 <= status < 300:
            return chain, at, "fetch_failed"
        return chain, at, None if kind and "text/html" in kind else "not_html"
    return chain, at, "fetch_failed"


@pytest.mark.parametrize("most", [0, 1, 5])
def test_chains_as_a_plain_walk(spark, most):
    rng = random.Random(7)
    urls = [f"https://s{k % 7}.example/p{k}" for k in range(80)]
    known = {}
    for k, u in enumerate(urls):
        kind = rng.random()
        if kind < 0.55:
            to = rng.choice([*urls, "http://127.0.0.1/", f"/p{rng.randrange(80)}", f"p{rng.randrange(80)}", u, None])
            known[u] = (rng.choice([301, 302, 307]), None, None, to, None)
        elif kind < 0.9:
            known[u] = (rng.choice([200, 200, 200, 204, 404, 503]), rng.choice(["text/html", "text/html; charset=x", "image/png", None]), None, None, f"<p>{k}")
    requests = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "request_id long, url string")
    responses = spark.createDataFrame([(u, *v) for u, v in known.items()], RESPONSES)
    got = {r["request_id"]: r for r in FE.outcomes(requests, responses, most=most).collect()}
    assert len(got) == 80
    for k, u in enumerate(urls):
        chain, final, error = walked(u, known, most)
        assert (got[k]["chain"], got[k]["final_url"], got[k]["error_code"]) == (chain, final, error)
        assert (got[k]["html"] is None) == (error is not None)


def test_odd_requests(spark):
    requests = spark.createDataFrame([(1, None), (2, ""), (3, "https://a.example/"), (3, "https://a.example/"), (4, "http://10.0.0.1/"), (5, "https://u:p@a.example/"), (6, "a.example/x"), (7, "https://big.example/")], "request_id long, url string")
    rows = [("https://A.example", 200, "text/html", None, None, None), ("https://a.example/", 200, "text/html", None, None, None), ("https://a.example/x", None, None, None, None, None), ("https://big.example/", 200, "text/html", 12, None, "é" * 6)]
    robots = spark.createDataFrame([("a.example", 200, "User-agent: *\nDisallow: /\n"), ("big.example", 500, "User-agent: *\nDisallow: /")], "host string, status int, body string")
    got = sorted((r["request_id"], r["error_code"], r["error_reason"], r["bytes"], r["truncated"]) for r in FE.outcomes(requests, spark.createDataFrame(rows, RESPONSES), robots, most_bytes=7).collect())
    assert got == [
        (1, "invalid_url", "unparsable", None, None), (2, "invalid_url", "unparsable", None, None), (3, "robots_disallowed", "robots.txt disallows /", None, None), (3, "robots_disallowed", "robots.txt disallows /", None, None),
        (4, "blocked_url", "ip_private", None, None), (5, "blocked_url", "credentials", None, None), (6, "fetch_failed", "no_response", None, None), (7, None, None, 7, True),
    ]
    assert FE.outcomes(requests.limit(0), spark.createDataFrame(rows, RESPONSES)).collect() == []
    late = spark.createDataFrame([("a.example", 200, "#" * 100_000 + "\nUser-agent: *\nDisallow: /")], "host string, status int, body string")
    assert FE.outcomes(requests.where("request_id = 3"), spark.createDataFrame(rows, RESPONSES), late).first()["error_code"] is None


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def test_sitemaps_are_found_as_listed(spark):
    b = "https://a.example"
    texts = [
        (f"{b}/robots.txt", f"Sitemap: {b}/none.xml\nsitemap: {b}/index.xml\nSitemap: {b}/off.xml\nSitemap: {b}/fourth.xml"), (f"{b}/fourth.xml", urlset(f"{b}/no")), (f"{b}/off.xml", urlset("https://b.example/x")),
        (f"{b}/index.xml", "<sitemapindex>" + "".join(f"<loc>{b}/c{k}.xml</loc>" for k in range(7)) + "</sitemapindex>"), (f"{b}/c0.xml", urlset(*(f"{b}/p{k}" for k in range(7)), f"{b}/P1/", "https://www.a.example/w?a=1&amp;b=2", f"{b}/x.pdf")),
        (f"{b}/c1.xml", urlset(f"{b}/q")), (f"{b}/c5.xml", urlset(f"{b}/sixth")), ("https://c.example/sitemap.xml", urlset("https://c.example/é")), ("https://d.example/sitemap.xml", "x" * 3_000_001 + urlset("https://d.example/y")),
    ]
    df = spark.createDataFrame([(u, 200, None, None, None, t) for u, t in texts], RESPONSES)
    sites = spark.createDataFrame([(u,) for u in (f"{b}/", "https://c.example/z", "https://d.example/", "http://localhost/")], "site_url string")
    got = {}
    for r in FE.discovered(sites, df, limit=3).collect():
        got.setdefault(r["site_url"], []).append(r)
    a = sorted(got[f"{b}/"], key=lambda r: r["nth"])
    # ten entries of the first child are under 4 * 3, so the second is read, too
    assert [(r["url"], r["sitemap_url"], r["via_robots"], r["total_found"], r["truncated"]) for r in a] == [(f"{b}/p{k}", f"{b}/index.xml", True, 9, True) for k in range(3)]
    assert [r["url"] for r in FE.discovered(sites.limit(1), df, limit=25).orderBy("nth").collect()][-2:] == ["https://www.a.example/w?a=1&b=2", f"{b}/q"]
    assert [(r["url"], r["via_robots"], r["error_code"]) for r in got["https://c.example/z"]] == [("https://c.example/é", False, None)]
    assert all([r["error_code"] for r in got[u]] == ["fetch_failed"] for u in ("https://d.example/", "http://localhost/"))


def test_hops_do_not_spell_addresses_again(spark):
    heads = FE._heads(spark.createDataFrame([("https://a.example/1", 302, "/2", None, None), ("https://a.example/2", 302, "3", None, None)], "url string, status int, location string, content_type string, content_length long"))
    led = FE.chains(heads)
    assert {r["key"]: r["chain"] for r in led.collect()} == {"https://a.example/1": ["https://a.example/2", "https://a.example/3"], "https://a.example/2": ["https://a.example/3"]}
    assert "regexp_extract" not in led._jdf.queryExecution().optimizedPlan().toString()


def test_addresses_are_spelled_once(spark):
    rows = spark.createDataFrame([(u, 200, None, None, None, "x") for u in ("https://e.com/a", " ", None)], RESPONSES)
    heads = FE._heads(rows)
    joined = spark.createDataFrame([("https://e.com/a",)], "key string").join(heads, "key", "left")
    assert joined._jdf.queryExecution().executedPlan().toString().count("<= 65535") == 1  # a port's bound, once a spelling
    assert [r["key"] for r in heads.collect()] == ["https://e.com/a"]

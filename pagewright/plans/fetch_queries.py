"""Queries of fetching and discovery over responses that are derived from pages, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import fetch as FE

from .registry import query
from .views import HOST, digit, host, sql_digit, table

S = SparkSession
#: The redirects of each page: https://host/go/id/8 leads to .../7, and so on to .../0 and the page; how a step says so (or
#: doesn't) comes of a digit: as an absolute address, from the root, relative, of another scheme's, with dots, not at all, to
#: a forbidden place, or to itself.
HOPS = 9
ROBOTS = "User-agent: *\nDisallow: /go/1\nAllow: /go/12\nDisallow: /page/2\n"


def hosted(spark: S, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), host(F.col("url")).alias("h"), "url", "html")


def requests(spark: S, d: str) -> DataFrame:
    p = hosted(spark, d)
    k, odd = (digit(F.col("id"), n) for n in (5, 6))
    path = F.when(k % 10 == 9, F.concat(F.lit("/page/"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("/go/"), F.col("id").cast("string"), F.lit("/"), (k % 10).cast("string")))
    plain = F.concat(F.lit("https://"), F.col("h"), path)
    url = F.when(odd == 0, F.concat(F.lit("HTTPS://"), F.upper("h"), F.lit(":443"), path, F.lit("#part"))).when(odd == 1, " ").when(odd == 2, F.lit("ftp://files.example/x")).when(odd == 3, F.lit("http://localhost/x")).when(odd == 4, F.concat(F.lit("https://"), F.col("h"), F.lit(":99999/"))).otherwise(plain)
    return p.select(F.col("id").alias("request_id"), url.alias("url"))


def responses(spark: S, d: str) -> DataFrame:
    p = hosted(spark, d)
    ids = F.col("id").cast("string")
    steps = p.select("id", "h", F.explode(F.sequence(F.lit(0), F.lit(HOPS - 1))).alias("k"))
    form, to = digit(F.col("id") * 10 + F.col("k"), 1), F.concat(F.lit("/go/"), ids, F.lit("/"), (F.col("k") - 1).cast("string"))
    place = (
        F.when(F.col("k") == 0, F.concat(F.lit("https://"), F.col("h"), F.lit("/page/"), ids)).when(form < 4, F.concat(F.lit("https://"), F.col("h"), to)).when(form < 8, to).when(form < 11, (F.col("k") - 1).cast("string"))
        .when(form == 11, F.concat(F.lit("//"), F.col("h"), to)).when(form == 12, F.concat(F.lit("../x/../"), ids, F.lit("/./"), (F.col("k") - 1).cast("string"), F.lit("#x"))).when(form == 14, "http://127.0.0.1/").when(form == 15, F.col("k").cast("string"))
    )
    moved = steps.select(F.concat(F.lit("https://"), F.col("h"), F.lit("/go/"), ids, F.lit("/"), F.col("k").cast("string")).alias("url"), F.lit(302).alias("status"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("long").alias("content_length"), place.alias("location"), F.lit(None).cast("string").alias("body"))
    s, c = digit(F.col("id"), 2), digit(F.col("id"), 3)
    kind = F.when(c < 12, "text/html; charset=utf-8").when(c == 12, "application/xhtml+xml").when(c == 13, "application/pdf").when(c == 15, "TEXT/HTML")
    ended = p.where(s != 13).select(F.concat(F.lit("https://"), F.col("h"), F.lit("/page/"), ids).alias("url"), F.when(s == 11, 404).when(s == 12, 500).otherwise(200).alias("status"), kind.alias("content_type"), F.when(digit(F.col("id"), 4) < 8, F.octet_length("html").cast("long")).alias("content_length"), F.lit(None).cast("string").alias("location"), F.col("html").alias("body"))
    return moved.unionByName(ended)


WALK = rf"""
p AS (SELECT page_id AS id, {HOST} AS h, html, {sql_digit('page_id', 2)} AS s, {sql_digit('page_id', 3)} AS c, {sql_digit('page_id', 4)} AS l, {sql_digit('page_id', 5)} % 10 AS k, {sql_digit('page_id', 6)} AS odd FROM pages),
starts AS (
  SELECT *, CASE WHEN k = 9 THEN -1 ELSE k END AS step, CASE odd WHEN 1 THEN 'invalid_url:unparsable' WHEN 2 THEN 'blocked_url:scheme' WHEN 3 THEN 'blocked_url:host' WHEN 4 THEN 'invalid_url:unparsable' END AS refused,
    CASE WHEN k = 9 THEN '/page/' || id ELSE '/go/' || id || '/' || k END AS path FROM p),
walk(id, step, n, error) AS (
  SELECT id, step, 1, NULL::VARCHAR FROM starts WHERE refused IS NULL
  UNION ALL
  SELECT id, CASE WHEN step = 0 THEN -1 WHEN form IN (13, 15) THEN step WHEN form = 14 THEN -2 ELSE step - 1 END, n + 1,
    CASE WHEN step > 0 AND form = 13 THEN 'fetch_failed:no_location' WHEN n = 6 THEN 'fetch_failed:too_many_redirects' WHEN step > 0 AND form = 14 THEN 'blocked_url:ip_private' END
  FROM (SELECT *, {sql_digit('id * 10 + step', 1)} AS form FROM walk WHERE step >= 0 AND error IS NULL)),
ends AS (SELECT *, CASE WHEN error = 'fetch_failed:no_location' THEN n - 1 ELSE n END AS asked FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1),
robots AS (SELECT h, {sql_digit('h', 1)} < 12 AS there FROM (SELECT DISTINCT h FROM p)),
said AS (
  SELECT s.*, e.step AS final, e.asked, coalesce(s.refused, e.error, CASE WHEN s.s = 11 THEN 'fetch_failed:status_404' WHEN s.s = 12 THEN 'fetch_failed:status_500' WHEN s.s = 13 THEN 'fetch_failed:no_response' WHEN s.c = 13 THEN 'not_html:application/pdf' WHEN s.c = 14 THEN 'not_html:unknown' END) AS error,
    s.refused IS NULL AND r.there AND (s.path LIKE '/go/1%' AND s.path NOT LIKE '/go/12%' OR s.path LIKE '/page/2%') AS kept_out, CASE WHEN s.path LIKE '/go%' THEN '/go/1' ELSE '/page/2' END AS rule
  FROM starts s LEFT JOIN ends e USING (id) JOIN robots r USING (h)),
full_errors AS (SELECT *, coalesce(error, CASE WHEN kept_out THEN 'robots_disallowed:robots.txt disallows ' || rule END) AS err FROM said)"""


def robots_files(spark: S, d: str) -> DataFrame:
    h = hosted(spark, d).select(F.col("h").alias("host")).distinct()
    return h.select("host", F.when(digit(F.col("host"), 1) < 12, 200).otherwise(404).alias("status"), F.lit(ROBOTS).alias("body"))


@query(rf"""WITH RECURSIVE {WALK}
SELECT id AS request_id, CASE WHEN refused LIKE 'invalid%' THEN NULL WHEN odd = 2 THEN 'ftp://files.example/x' WHEN odd = 3 THEN 'http://localhost/x' WHEN final = -2 THEN 'http://127.0.0.1/' WHEN final = -1 THEN 'https://' || h || '/page/' || id ELSE 'https://' || h || '/go/' || id || '/' || final END AS final_url,
  CAST(CASE WHEN refused IS NULL THEN asked ELSE 0 END AS INTEGER) AS n_asked, CASE WHEN err IS NOT NULL THEN split_part(err, ':', 1) END AS error_code, CASE WHEN err IS NOT NULL THEN regexp_extract(err, '^[a-z_]+:(.*)$', 1) END AS error_reason,
  CASE WHEN err IS NULL THEN least(strlen(html), 2000) END AS bytes, CASE WHEN err IS NULL AND l < 8 THEN strlen(html) END AS total_bytes, CASE WHEN err IS NULL THEN strlen(html) > 2000 END AS truncated,
  CASE WHEN err IS NULL THEN md5(html) END AS html_md5, NOT kept_out AS robots_allowed
FROM full_errors""")
def s01_s03_fetch_outcomes(spark: S, d: str) -> DataFrame:
    """All requests, with a cap of 2000 bytes so that some pages are over it."""
    got = FE.outcomes(requests(spark, d), responses(spark, d), robots_files(spark, d), most_bytes=2000)
    return got.select("request_id", "final_url", F.size("chain").alias("n_asked"), "error_code", "error_reason", "bytes", "total_bytes", "truncated", F.md5(F.col("html").cast("binary")).alias("html_md5"), "robots_allowed")


@query(rf"""WITH RECURSIVE {WALK}, codes AS (SELECT split_part(err, ':', 1) AS error_code FROM full_errors WHERE err IS NOT NULL)
SELECT error_code, CASE error_code WHEN 'invalid_url' THEN 400 WHEN 'not_html' THEN 400 WHEN 'blocked_url' THEN 403 WHEN 'robots_disallowed' THEN 403 ELSE 502 END AS http_status, count(*) AS n FROM codes GROUP BY ALL""")
def b06_error_rows(spark: S, d: str) -> DataFrame:
    """How many requests end in each error, with the status that an answer to them has."""
    from pagewright.operators import report as RP

    got = FE.outcomes(requests(spark, d), responses(spark, d), robots_files(spark, d)).where("error_code IS NOT NULL")
    return got.groupBy("error_code").agg(F.count("*").alias("n")).select("error_code", RP.error_status(F.col("error_code")).alias("http_status"), "n")


def _set(entries: Column) -> Column:
    one = F.transform(entries, lambda u: F.concat(F.lit("<url><loc>\n "), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>")))
    return F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join(one, ""), F.lit("</urlset>"))


def sitemap_texts(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    """Sites, and the robots files and sitemaps of their hosts: which there are, and which are indexes, comes of digits."""
    p = hosted(spark, d)
    pages = p.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("id", "url"))).alias("ps"))
    base = F.concat(F.lit("https://"), F.col("h"))
    hosts = pages.select("h", base.alias("base"), digit(F.col("h"), 1).alias("a"), digit(F.col("h"), 2).alias("b"), "ps")
    urls = lambda keep: F.transform(F.filter("ps", keep), lambda x: x["url"])
    part = lambda j: urls(lambda x: x["id"] % 7 == j)
    whole = F.concat(urls(lambda x: F.lit(True)), F.array(F.concat("base", F.lit("/a.PNG?x")), F.lit("https://elsewhere.example/x")), F.transform(F.slice(urls(lambda x: F.lit(True)), 1, 1), lambda u: F.concat(F.upper(F.regexp_replace(u, "/$", "")), F.lit("/"))))
    index = F.concat(F.lit("<SitemapIndex >"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: F.concat(F.lit("<sitemap><LOC>"), F.col("base"), F.lit("/part/"), j.cast("string"), F.lit(".xml</LOC></sitemap>"))), ""), F.lit("</SitemapIndex>"))
    lines = F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda k: k < F.col("a") % 6), lambda k: F.concat(F.lit("\n  SiteMap: "), F.col("base"), F.lit("/maps/"), k.cast("string"), F.lit(".xml")))
    row = lambda path, body: F.struct(F.concat("base", path).alias("url"), body.alias("body"))
    made = [
        F.when(F.col("a") < 10, row(F.lit("/robots.txt"), F.concat(F.lit("User-agent: *"), F.array_join(lines, "")))),
        *[F.when((F.col("a") + k) % 3 != 0, row(F.lit(f"/maps/{k}.xml"), F.when((F.col("b") + k) % 2 == 0, index).otherwise(_set(whole)))) for k in range(5)],
        F.when(F.col("b") % 4 != 0, row(F.lit("/sitemap.xml"), _set(urls(lambda x: x["id"] % 2 == 0)))), row(F.lit("/sitemap_index.xml"), index),
        *[F.when((F.col("b") + j) % 4 != 1, row(F.lit(f"/part/{j}.xml"), _set(F.concat(part(j), F.array(F.lit("https://elsewhere.example/y")))))) for j in range(7)],
    ]
    texts = hosts.select(F.inline(F.filter(F.array(*made), lambda x: x.isNotNull()))).withColumns({"status": F.lit(200), "content_length": F.lit(None).cast("long")})
    return hosts.select(F.concat("base", F.lit("/")).alias("site_url")), texts


@query(rf"""WITH p AS (SELECT page_id AS id, {HOST} AS h, url FROM pages), hosts AS (SELECT h, {sql_digit('h', 1)} AS a, {sql_digit('h', 2)} AS b FROM (SELECT DISTINCT h FROM p)),
cand AS (
  SELECT h, b, k AS place_no, 'https://' || h || '/maps/' || k || '.xml' AS sitemap_url, true AS via_robots, (b + k) % 2 = 0 AS is_index, 0 AS even FROM hosts, range(3) r(k) WHERE a < 10 AND k < a % 6 AND (a + k) % 3 <> 0
  UNION ALL SELECT h, b, 3, 'https://' || h || '/sitemap.xml', false, false, 1 FROM hosts WHERE b % 4 <> 0
  UNION ALL SELECT h, b, 4, 'https://' || h || '/sitemap_index.xml', false, true, 0 FROM hosts),
kids AS (SELECT c.*, j FROM cand c, range(5) r(j) WHERE is_index AND (b + j) % 4 <> 1),
sized AS (SELECT k.*, 1 + (SELECT count(*) FROM p WHERE p.h = k.h AND p.id % 7 = k.j) AS n FROM kids k),
kept AS (SELECT * FROM sized QUALIFY coalesce(sum(n) OVER (PARTITION BY h, place_no ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 12),
ent AS (
  SELECT c.h, place_no, sitemap_url, via_robots, 0 AS child, id AS place, url FROM cand c JOIN p USING (h) WHERE NOT is_index AND (even = 0 OR id % 2 = 0)
  UNION ALL SELECT k.h, place_no, sitemap_url, via_robots, j, id, url FROM kept k JOIN p ON p.h = k.h AND p.id % 7 = j),
once AS (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY h, place_no, lower(regexp_replace(url, '/$', '')) ORDER BY child, place) = 1),
fit AS (SELECT *, row_number() OVER (PARTITION BY h, place_no ORDER BY child, place) AS nth, count(*) OVER (PARTITION BY h, place_no) AS total_found FROM once WHERE NOT regexp_matches(url, '(?i)\.(jpe?g|png|gif|webp|svg|pdf|zip|mp4|mp3|css|js|xml|json)(\?|$)')),
won AS (SELECT * FROM fit QUALIFY place_no = min(place_no) OVER (PARTITION BY h))
SELECT 'https://' || hosts.h || '/' AS site_url, sitemap_url, via_robots, nth, url, total_found, total_found > 3 AS truncated, CASE WHEN nth IS NULL THEN 'fetch_failed' END AS error_code FROM hosts LEFT JOIN (SELECT * FROM won WHERE nth <= 3) w ON w.h = hosts.h""")
def s05_discovery(spark: S, d: str) -> DataFrame:
    return FE.discovered(*sitemap_texts(spark, d), limit=3)

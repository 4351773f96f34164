"""Fetching as joins with recorded responses: redirect chains, typed outcomes, robots files, sitemap discovery.

A response is a row of url, status, content_type, content_length, location and body; a request that got none has no row, or
a null status. Addresses meet by `key`, so that spellings of one address are one. Of repeated responses to an address the
one of the least status, location, type and length counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import let
from pagewright.sources.held import held

from . import intake as I

#: Redirects that are followed; characters read of a robots file, and most of a sitemap; child sitemaps of an index.
REDIRECTS, ROBOTS_CHARS, SITEMAP_CHARS, CHILDREN = 5, 100_000, 3_000_000, 5
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"


def without_dots(path: Column) -> Column:
    """A path without its `.` and `..` segments; `..` never leaves the root."""
    none = F.array().cast("array<string>")

    def cleaned(p: Column) -> Column:
        kept = F.aggregate(F.split(p, "/"), none, lambda out, s: F.when(F.lower(s).isin(".", "%2e"), out).when(F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e"), F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(s))))
        folder = F.when(p.rlike(r"(?i)(^|/)(\.|%2e){1,2}$"), "/").otherwise("")
        return F.when(p.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)"), F.concat(F.array_join(kept, "/"), folder)).otherwise(p)

    return let(path, cleaned)


def absolute(href: Column, base: Column) -> Column:
    """The address that href means on the page at `base`, an absolute one."""
    get = lambda c, pattern, n=0: F.regexp_extract(c, pattern, n)

    def joined(x: Column) -> Column:
        h, b = x["h"], x["b"]
        origin, path = get(b, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*"), get(b, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        own, rest = get(h, r"^[^?#]*"), get(h, r"^[^?#]*(.*)$", 1)
        folder = F.when(path == "", "/").otherwise(get(path, "^.*/"))
        return (
            F.when(h.rlike(SCHEME), h).when(h.startswith("//"), F.concat(get(b, SCHEME), h)).when(h == "", b).when(h.startswith("#"), F.concat(b, h))
            .when(h.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), h)).when(h.startswith("/"), F.concat(origin, without_dots(own), rest)).otherwise(F.concat(origin, without_dots(F.concat(folder, own)), rest))
        )

    return let(F.struct(F.trim(href).alias("h"), F.regexp_replace(base, "#.*$", "").alias("b")), joined)


def key(url: Column) -> Column:
    """An address's one spelling: lower-case scheme and host, no default port, no dot segments, no fragment; null if it has no
    host, or one that no address can have, or a port over 65535. Other schemes than http and https stay as they are."""

    def spelled(x: Column) -> Column:
        web = x["scheme"].isin("http", "https")
        usual = (x["port"] == "") | ((x["scheme"] == "https") & (x["port"] == "443")) | ((x["scheme"] == "http") & (x["port"] == "80"))
        port = F.when(usual, "").otherwise(F.concat(F.lit(":"), x["port"]))
        user = F.when(x["user"] != "", F.concat(x["user"], F.lit("@"))).otherwise("")
        bad = (x["host"] == "") | x["host"].rlike(r"[\s<>^|%\\]|^\[.*[^0-9a-f:.\]].*\]$") | (F.coalesce(F.when(x["port"] != "", x["port"].try_cast("long")), F.lit(0)) > 65535)
        path, query = F.regexp_extract(x["rest"], r"^[^?]*", 0), F.regexp_extract(x["rest"], r"^[^?]*(.*)$", 1)
        return F.when(x["t"] == "", None).when(~web, x["t"]).when(~bad, F.concat(x["scheme"], F.lit("://"), user, x["host"], port, without_dots(path), query))

    return let(F.trim(url), lambda t: let(F.struct(t.alias("t"), *[c.alias(n) for n, c in I.parts(t).items()]), spelled))


def _spelled(rows: DataFrame, name: str, *rest: Column | str) -> DataFrame:
    """The key of each row's url and the rest of its columns; rows without a key are left out. A filter on the key, as joins have
    it too, would be pushed below and spell each address once more, so the key comes of an explode."""
    return rows.select(F.explode(F.filter(F.array(key(F.col("url"))), lambda k: k.isNotNull())).alias(name), *rest)


def _heads(responses: DataFrame) -> DataFrame:
    """key and head (status, location, content_type, content_length), a row an address; bodies aren't read."""
    rows = _spelled(responses, "key", F.struct(F.col("status").isNull().alias("none"), "status", "location", "content_type", "content_length").alias("head"))
    return rows.groupBy("key").agg(F.min("head").alias("head"))


def host_of(address: Column) -> Column:
    return let(address, lambda a: I.parts(a)["host"])


def blocked(address: Column) -> Column:
    """blocked_url and why the address may not be asked; null if it may."""
    return F.concat(F.lit("blocked_url:"), let(address, I.refusal))


def chains(heads: DataFrame, most: int = REDIRECTS) -> DataFrame:
    """Where each redirecting address leads: key, chain (the addresses after it) and error (code:reason, or null).

    All redirects are followed at the same time, a hop a join of the redirecting addresses with themselves, `most` + 1 times:
    each hop's address is checked before it is asked, and one that redirects once more ends in an error, as loops do. Pages
    themselves take no part: they meet the finished chains once.
    """
    moves = heads.where("head.status BETWEEN 300 AND 399").select("key", F.col("head.location").alias("location"))
    moves = moves.withColumn("to", key(absolute(F.col("location"), F.col("key"))))
    error = F.when(F.coalesce(F.trim("location"), F.lit("")) == "", "fetch_failed:no_location").when(F.col("to").isNull(), "fetch_failed:bad_location")
    moves = moves.select("key", F.when(error.isNull(), F.col("to")).alias("target"), error.alias("error")).withColumn("forbidden", blocked(F.col("target")))
    moves = held(moves)  # read by each hop
    step = moves.select(F.col("key").alias("at"), F.col("target").alias("next"), F.col("error").alias("fault"), F.col("forbidden").alias("no"))
    live = moves.select("key", F.col("target").alias("last"), F.when(F.col("target").isNotNull(), F.array("target")).otherwise(F.array().cast("array<string>")).alias("chain"), F.coalesce("error", F.col("forbidden") if most else F.lit("fetch_failed:too_many_redirects")).alias("error"))
    for hop in range(1, most + 1):
        joined = live.join(step, F.col("last") == F.col("at"), "left")
        moved = F.col("at").isNotNull() & F.col("error").isNull()
        then = F.coalesce("fault", F.lit("fetch_failed:too_many_redirects") if hop == most else F.col("no"))
        live = joined.select(
            "key", F.when(moved & F.col("next").isNotNull(), F.col("next")).otherwise(F.col("last")).alias("last"), F.when(moved & F.col("next").isNotNull(), F.concat("chain", F.array("next"))).otherwise(F.col("chain")).alias("chain"),
            F.when(moved, then).otherwise(F.col("error")).alias("error"),
        )
    return live


def outcomes(requests: DataFrame, responses: DataFrame, robots: DataFrame | None = None, most: int = REDIRECTS, agent: str = "pagewright", most_bytes: int = I.PAGE_BYTES) -> DataFrame:
    """What fetching each requested url comes to, a row for each row of requests (request_id, url):

    request_id, url, final_url, chain (all addresses asked, the first included), error_code (invalid_url, blocked_url,
    fetch_failed, not_html, robots_disallowed, or null for a page), error_reason, status, content_type, html (null for
    errors), bytes (read, at most most_bytes), total_bytes (declared; null for none), truncated, robots_allowed, robots_reason.

    robots has host, status and body; a host without one, or with another status than 2xx, allows everything, and so do
    requests that can't be parsed. Only its first ROBOTS_CHARS characters are read. What a robots file says of the requested
    address counts after the fetch itself. Null and empty urls are invalid; repeated requests have a row each.
    """
    heads = held(_heads(responses))  # addresses are dear to spell, and each hop reads them
    asked = requests.select("request_id", "url", key(F.col("url")).alias("key"))
    asked = asked.withColumn("refused", F.when(F.col("key").isNull(), "invalid_url:unparsable").otherwise(blocked(F.col("key"))))
    led = asked.join(chains(heads, most).select("key", F.col("last").alias("led"), F.col("chain").alias("more"), "error"), "key", "left")
    led = led.withColumns({"final_url": F.coalesce("led", "key"), "error": F.coalesce("refused", "error")})
    ended = led.join(heads.withColumnRenamed("key", "final_url"), "final_url", "left")
    status, kind = F.col("head.status"), F.coalesce("head.content_type", F.lit(""))
    error = F.coalesce("error", F.when(status.isNull(), "fetch_failed:no_response").when(~status.between(200, 299), F.concat(F.lit("fetch_failed:status_"), status.cast("string"))).when(~kind.rlike(r"(?i)text/html|application/xhtml\+xml"), F.concat(F.lit("not_html:"), F.when(kind == "", "unknown").otherwise(kind))))
    ended = ended.withColumn("error", error)

    if robots is not None:
        read = robots.where("status BETWEEN 200 AND 299").select(F.lower("host").alias("host"), F.left("body", F.lit(ROBOTS_CHARS)).alias("body"))
        part = lambda n: F.coalesce(let(F.col("key"), lambda k: I.parts(k)[n]), F.lit(""))
        ended = I.robots_allowed(ended.withColumns({"host": part("host"), "path": part("rest")}), I.robots_rules(read, agent))
    else:
        ended = ended.withColumns({"allowed": F.lit(True), "reason": F.lit(None).cast("string")})
    ended = ended.withColumn("error", F.coalesce("error", F.when(~F.col("allowed"), F.concat(F.lit("robots_disallowed:"), F.col("reason")))))

    bodies = _spelled(responses.where("status BETWEEN 200 AND 299"), "final_url", F.struct("status", "location", "content_type", "content_length").alias("of"), "body")
    bodies = bodies.groupBy("final_url").agg(F.min_by("body", "of").alias("body"))
    whole = ended.join(bodies, "final_url", "left")
    good, size = F.col("error").isNull(), F.octet_length("body")
    code, reason = F.split_part("error", F.lit(":"), F.lit(1)), F.regexp_extract("error", "^[a-z_]+:(.*)$", 1)
    return whole.select(
        "request_id", "url", "final_url", F.when(F.col("refused").isNull(), F.concat(F.array("key"), F.coalesce("more", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>")).alias("chain"),
        code.alias("error_code"), F.when(~good, reason).alias("error_reason"), F.when(F.col("refused").isNull(), F.col("head.status")).alias("status"), F.when(F.col("refused").isNull(), F.col("head.content_type")).alias("content_type"),
        F.when(good, F.coalesce("body", F.lit(""))).alias("html"), F.when(good, F.least(F.coalesce(size, F.lit(0)), F.lit(most_bytes)).cast("long")).alias("bytes"),
        F.when(good & (F.col("head.content_length") > 0), F.col("head.content_length").cast("long")).alias("total_bytes"), F.when(good, F.coalesce(size, F.lit(0)) > most_bytes).alias("truncated"), F.col("allowed").alias("robots_allowed"), F.col("reason").alias("robots_reason"),
    )


def discovered(sites: DataFrame, texts: DataFrame, limit: int = 25) -> DataFrame:
    """The pages that each site's sitemaps name, a row for each of the first `limit`: site_url, sitemap_url, via_robots, nth
    (from 1), url, total_found, truncated and error_code (a site without any has one row, with fetch_failed).

    sites has site_url; texts are responses. Candidates are the first three sitemaps that the robots file names, then
    /sitemap.xml and /sitemap_index.xml; the first that has a page of the site's own host (with or without www., no assets)
    wins. An index stands for its first CHILDREN sitemaps in their order, up to the one with which they have 4 * limit
    entries. Entries that differ in case or a closing slash are one. Texts over SITEMAP_CHARS, addresses that may not be
    asked and failed requests count as none.

    The levels are joins: robots files, candidates, children. All candidates of all sites are read side by side, where one
    after the other would wait for each answer; a sitemap's entries are bounded by its size, so that windows by candidate
    are, too.
    """
    read = texts.where("status BETWEEN 200 AND 299").where("body IS NOT NULL AND body != ''")
    read = _spelled(read, "key", "content_length", "body")
    read = read.groupBy("key").agg(F.min(F.struct("content_length", "body")).alias("x")).select("key", F.col("x.content_length").alias("declared"), "x.body")
    own = sites.select("site_url").distinct().withColumn("site", key(F.col("site_url")))
    own = own.withColumn("host", F.regexp_replace(host_of(F.col("site")), r"^www\.", ""))
    small = read.where((F.length("body") <= SITEMAP_CHARS) & (F.coalesce("declared", F.lit(0)) <= SITEMAP_CHARS))
    at = lambda path: key(absolute(F.lit(path), F.col("site")))
    robots = own.withColumn("key", at("/robots.txt")).where(blocked(F.col("key")).isNull()).join(small, "key")
    named = F.slice(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), 1, 3)
    listed = robots.select("site_url", "site", "host", F.posexplode(named).alias("at", "address")).withColumn("via_robots", F.lit(True))
    usual = own.select("site_url", "site", "host", F.posexplode(F.array(at("/sitemap.xml"), at("/sitemap_index.xml"))).alias("at", "address")).select("site_url", "site", "host", (F.col("at") + 3).alias("at"), "address", F.lit(False).alias("via_robots"))
    rated = listed.unionByName(usual).withColumn("key", F.when(F.col("address").rlike(SCHEME), key(F.col("address"))))
    candidates = rated.where(F.col("key").isNotNull() & blocked(F.col("key")).isNull()).join(small, "key").select("site_url", "host", "at", F.col("key").alias("sitemap_url"), "via_robots", "body")

    entries = I.sitemap_urls(candidates).withColumnRenamed("ord", "place")
    plain = entries.where("kind = 'urlset'").select("site_url", "host", "at", "sitemap_url", "via_robots", F.lit(0).alias("child"), "place", "url")
    nth = Window.partitionBy("site_url", "at").orderBy("place")
    children = entries.where("kind = 'index'").withColumn("child", F.row_number().over(nth) - 1).where(F.col("child") < CHILDREN)
    children = children.withColumn("key", F.when(F.col("url").rlike(SCHEME), key(F.col("url")))).where(F.col("key").isNotNull() & blocked(F.col("key")).isNull())
    below = I.sitemap_urls(children.drop("kind", "place", "url").join(small.select("key", "body"), "key")).withColumnRenamed("ord", "place")
    # A child is read while those before it have under 4 * limit entries.
    counts = below.groupBy("site_url", "at", "child").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("site_url", "at").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < 4 * limit)
    below = below.join(counts.select("site_url", "at", "child"), ["site_url", "at", "child"])
    every = plain.unionByName(below.select(*plain.columns))

    spelled = F.lower(F.regexp_replace("url", "/$", ""))
    once = every.withColumn("first", F.row_number().over(Window.partitionBy("site_url", "at", spelled).orderBy("child", "place"))).where("first = 1")
    once = once.withColumn("there", key(I.with_scheme(F.col("url"))))
    same = F.regexp_replace(host_of(F.col("there")), r"^www\.", "") == F.col("host")
    fit = once.where(F.coalesce(same & blocked(F.col("there")).isNull() & ~I.is_asset(F.col("url")), F.lit(False)))
    order = Window.partitionBy("site_url", "at").orderBy("child", "place")
    counted = fit.withColumns({"nth": F.row_number().over(order).cast("long"), "total_found": F.count("*").over(Window.partitionBy("site_url", "at"))})
    best = counted.groupBy("site_url").agg(F.min("at").alias("at"))
    kept = counted.join(best, ["site_url", "at"]).where(F.col("nth") <= limit)
    found = kept.select("site_url", "sitemap_url", "via_robots", "nth", "url", "total_found", (F.col("total_found") > limit).alias("truncated"))
    return own.select("site_url").join(found, "site_url", "left").withColumn("error_code", F.when(F.col("nth").isNull(), "fetch_failed"))

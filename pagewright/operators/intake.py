"""Addresses, robots files and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import let

BLOCKED_NAMES = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata.google.internal")
BLOCKED_SUFFIXES = (".local", ".internal", ".localhost", ".home.arpa", ".onion")
ASSET = r"(?i)\.(jpe?g|png|gif|webp|svg|pdf|zip|mp4|mp3|css|js|xml|json)(\?|$)"
PAGE_BYTES = 250_000


def with_scheme(url: Column) -> Column:
    t = F.trim(url)
    return F.when(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), t).otherwise(F.concat(F.lit("https://"), t))


def parts(url: Column) -> dict[str, Column]:
    """scheme, user, host (lower case), port and rest (path and query, at least `/`) of an absolute URL."""
    u = with_scheme(url)
    get = lambda n: F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):(?://(?:([^@/?#]*)@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d*))?)?([^#]*)", n)
    rest = get(5)
    return {"scheme": F.lower(get(1)), "user": get(2), "host": F.lower(get(3)), "port": get(4), "rest": F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))}


def ipv4(host: Column) -> Column:
    """The number of an IPv4 host in any spelling: one to four parts, each decimal, octal or hex; null for other hosts."""
    number = lambda p: F.when(p.rlike("^0[xX][0-9a-fA-F]{1,12}$"), F.conv(F.substring(p, F.lit(3), F.length(p)), 16, 10)).when(p.rlike("^0[0-7]{1,15}$"), F.conv(p, 8, 10)).when(p.rlike(r"^\d{1,15}$"), p).cast("long")

    def whole(nums: Column) -> Column:
        n = F.size(nums)
        heads = F.slice(nums, F.lit(1), F.greatest(n - 1, F.lit(0)))
        last = F.element_at(nums, -1)
        room = F.element_at(F.array(*[F.lit(256**k).cast("long") for k in (4, 3, 2, 1)]), F.least(n, F.lit(4)))
        valid = (n <= 4) & F.forall(nums, lambda x: x.isNotNull()) & F.forall(heads, lambda x: x < 256) & (last < room)
        return F.when(F.coalesce(valid, F.lit(False)), F.aggregate(heads, F.lit(0).cast("long"), lambda a, x: a * 256 + x) * room + last)

    return F.when(host.rlike("^[0-9]"), let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number), whole))  # names aren't taken apart


def is_private(number: Column) -> Column:
    a, b = F.floor(number / (1 << 24)), F.floor(number / (1 << 16)) % 256
    return a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224)


def refusal(url: Column) -> Column:
    """Why an address may not be fetched: empty, scheme, credentials, host, suffix, ip_private, ip or ipv6; null if it may."""

    def why(p: Column) -> Column:
        host, number = p["bare"], p["number"]
        suffix = host.rlike("(" + "|".join(x.replace(".", r"\.") for x in BLOCKED_SUFFIXES) + ")$")
        return (
            F.when(p["t"] == "", "empty").when(~p["scheme"].isin("http", "https"), "scheme").when(p["user"] != "", "credentials").when(host == "", "empty")
            .when(host.isin(*BLOCKED_NAMES), "host").when(suffix, "suffix").when(host.startswith("["), "ipv6").when(is_private(number), "ip_private").when(number.isNotNull(), "ip")
        )

    def judged(t: Column) -> Column:
        p = parts(t)
        bare = F.regexp_replace(p["host"], r"\.$", "")
        known = F.struct(t.alias("t"), p["scheme"].alias("scheme"), p["user"].alias("user"), bare.alias("bare"))
        return let(known, lambda k: let(F.struct(k["t"].alias("t"), k["scheme"].alias("scheme"), k["user"].alias("user"), k["bare"].alias("bare"), ipv4(k["bare"]).alias("number")), why))

    return let(F.coalesce(F.trim(url), F.lit("")), judged)


def normalized(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, at least the path `/`; null if refused."""
    p = parts(url)
    port = F.when((p["port"] == "") | ((p["scheme"] == "https") & (p["port"] == "443")) | ((p["scheme"] == "http") & (p["port"] == "80")), "").otherwise(F.concat(F.lit(":"), p["port"]))
    return F.when(refusal(url).isNull(), F.concat(p["scheme"], F.lit("://"), p["host"], port, p["rest"]))


def backend(url: Column, allow_private: bool = False) -> tuple[Column, Column]:
    """Address (origin and path without a closing slash) of a decision service, and why it is refused (as refusal(); `invalid`
    without a scheme). allow_private lets hosts and numbers of the local network pass. The address is null if refused."""
    p = parts(url)
    why = refusal(url)
    ours = F.when(why.isin("host", "suffix", "ipv6", "ip_private", "ip"), None).otherwise(why) if allow_private else why
    t = F.trim(url)
    why = F.when(F.coalesce(t, F.lit("")) == "", "empty").when(~t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), "invalid").otherwise(ours)
    port = F.when((p["port"] == "") | ((p["scheme"] == "https") & (p["port"] == "443")) | ((p["scheme"] == "http") & (p["port"] == "80")), "").otherwise(F.concat(F.lit(":"), p["port"]))
    path = F.regexp_replace(F.regexp_extract(p["rest"], r"^[^?]*", 0), "/$", "")
    return F.when(why.isNull(), F.concat(p["scheme"], F.lit("://"), p["host"], port, path)), why


def site(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def is_asset(url: Column) -> Column:
    return url.rlike(ASSET)


def distinct_urls(urls: DataFrame, url: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Keeps the first of addresses that differ in case or a trailing slash only."""
    key = F.lower(F.regexp_replace(F.col(url), "/$", ""))
    own = Window.partitionBy(*(by or []), key).orderBy(*order)
    return urls.withColumn("_nth", F.row_number().over(own)).where("_nth = 1").drop("_nth")


def capped_body(html: Column, most: int = PAGE_BYTES) -> dict[str, Column]:
    size = F.octet_length(html)
    return {"total_bytes": size.cast("long"), "kept_bytes": F.least(size, F.lit(most)).cast("long"), "truncated": size > most}


def robots_rules(robots: DataFrame, agent: str = "pagewright") -> DataFrame:
    """host, ord, allow, path of the rules that hold for the agent, from host and body.

    Agent lines in a row form a group; groups for `*` and for the agent hold together. Comments and rules without a value
    are left out.
    """
    lines = robots.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("ord", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", "")))
    lines = lines.where(F.contains("line", F.lit(":")) & ~F.col("line").startswith(":"))
    at = F.instr("line", ":")
    lines = lines.select("host", "ord", F.lower(F.trim(F.expr("substr(line, 1, instr(line, ':') - 1)"))).alias("key"), F.trim(F.substring("line", at + 1, F.length("line"))).alias("value"))
    by = Window.partitionBy("host").orderBy("ord")
    agent_line = F.col("key") == "user-agent"
    lines = lines.withColumn("starts", (agent_line & (F.coalesce(F.lag("key").over(by), F.lit("")) != "user-agent")).cast("int")).withColumn("grp", F.sum("starts").over(by))
    holds = F.max((agent_line & ((F.lower("value") == "*") | F.contains(F.lower("value"), F.lit(agent)))).cast("int")).over(Window.partitionBy("host", "grp"))
    lines = lines.withColumn("holds", holds)
    return lines.where((F.col("holds") == 1) & (F.col("grp") > 0) & F.col("key").isin("allow", "disallow") & (F.col("value") != "")).select("host", "ord", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path, ...) with allowed and reason: the longest rule that the path begins with holds, the first of equals."""
    keyed = urls.select("host", "path").distinct()
    met = keyed.join(rules.withColumnRenamed("path", "rule"), "host").where(F.col("path").startswith(F.col("rule")))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("allow", "rule"), F.struct(F.length("rule"), -F.col("ord"))).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    allowed = F.coalesce(F.col("best.allow"), F.lit(True))
    return out.withColumn("allowed", allowed).withColumn("reason", F.when(~allowed, F.concat(F.lit("robots.txt disallows "), F.col("best.rule")))).drop("best")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """kind (index or urlset), ord and url of each entry of the sitemaps in body; other columns stay.

    The kind goes with the entries: as a column beside them it would be looked for in the whole body for each of them."""
    xml = F.col("body")
    kind = F.when(xml.rlike(r"(?i)<sitemapindex[\s>]"), "index").otherwise("urlset")
    locs = F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
    entries = let(F.struct(kind.alias("kind"), locs.alias("locs")), lambda x: F.transform(x["locs"], lambda loc, at: F.struct(x["kind"].alias("kind"), at.alias("ord"), loc.alias("loc"))))
    decoded = F.col("loc")
    for entity, c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        decoded = F.replace(decoded, F.lit(entity), F.lit(c))
    rest = [c for c in sitemaps.columns if c != "body"]
    return sitemaps.select(*rest, F.inline(entries)).select(*rest, "kind", "ord", F.trim(decoded).alias("url")).where("url != ''")

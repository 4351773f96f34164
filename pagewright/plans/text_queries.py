"""Queries of scalar and passage operators. Where the English rules find next to nothing in the tables' invented words, a
query binds other rules of the same form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions import text as T
from pagewright.operators import content as C
from pagewright.operators import intake as I

from .registry import query
from .views import HOST, LINES, NAV_LINKS, PAGES, extracted, host, lines, nav_links, table

S = SparkSession
W = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w != ''))"
#: Sentences, blank ones left out, as SQL.
SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s != '')"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''-]*')"

#: Rules of frequent words that stand in for the English ones.
LEXICON = (("of the", "b"), ("thend", "a"), ("with", "a"), ("the", "a"), ("de", "b"), ("of", "b"))
FAMILIES = (("first", r"and the|en la|in der", "one thing"), ("second", r"of|de|die", "another"))
PROOF = (("figure", r"\b\d"), ("source", r"\b(is|was|est)\b"))


def sql_at(term: str) -> str:
    t = term.replace("-", r"\-")
    return rf"CASE WHEN regexp_matches(lower(text), '(?:^|[^\p{{L}}-]){t}(?:[^\p{{L}}-]|$)') THEN length(regexp_extract(lower(text), '(?s)^(.*?(?:^|[^\p{{L}}-])){t}(?:[^\p{{L}}-]|$)', 1)) + 1 ELSE 0 END"


def sql_hype(limit: int) -> str:
    """The ordered fold over LEXICON, a column at a time."""
    steps = "SELECT *, " + ", ".join(f"{sql_at(t)} AS a{k}" for k, (t, _) in enumerate(LEXICON)) + " FROM lines"
    for k in range(len(LEXICON)):
        free = " AND ".join([f"a{k} > 0", *(f"NOT (k{j} AND abs(a{k} - a{j}) < 2)" for j in range(k))])
        steps = f"SELECT *, {free} AS k{k} FROM ({steps})"
    made = ", ".join(f"CASE WHEN k{k} THEN {{'at': a{k}, 'term': '{t}'}} END" for k, (t, _) in enumerate(LEXICON))
    return f"SELECT *, list_sort(list_filter([{made}], lambda x: x IS NOT NULL))[:{limit}] AS found FROM ({steps})"


HYPE = f"hyped AS ({sql_hype(6)})"


@query(f"WITH {LINES} SELECT page_id, passage_ord, ceil(length(text) / 3.5)::BIGINT AS tokens, {W} AS n_words, length(text) AS n_chars FROM lines")
def p08_p14_sizes(spark: S, d: str) -> DataFrame:
    return lines(spark, d).select("page_id", "passage_ord", T.estimated_tokens(F.col("text")).alias("tokens"), T.words(F.col("text")).alias("n_words"), F.length("text").alias("n_chars"))


@query(f"WITH {LINES} SELECT page_id, passage_ord, contains(text, '?') OR regexp_matches(text, '(?i)^(?:{'|'.join(rules.QUESTION_WORDS)})\\b') AS asks, n >= 2 AND length(text) >= 4 AND NOT (n <= 3 AND regexp_matches(text, '^[A-Z][a-z]+(\\s[A-Z][a-z]+){{1,2}}$')) OR (length(text) >= 4 AND contains(text, '?')) AS promises FROM (SELECT *, {W} AS n FROM lines)")
def p09_p10_headings(spark: S, d: str) -> DataFrame:
    return lines(spark, d).select("page_id", "passage_ord", T.is_question(F.col("text")).alias("asks"), T.is_promissory(F.col("text")).alias("promises"))


@query(rf"""WITH heads AS (SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[:3], ' ') AS t FROM documents)
SELECT doc_id, t = '' OR (NOT contains(t, '?') AND NOT regexp_matches(t, '(?i)\b(?:{rules.TOPIC_WORDS})\b') AND regexp_matches(t, '^\p{{L}}[\p{{L}}\p{{N}}''’._\-]*(\s+\p{{L}}[\p{{L}}\p{{N}}''’._\-]*){{0,3}}$')) AS named FROM heads""")
def p11_name_like(spark: S, d: str) -> DataFrame:
    head = F.array_join(F.slice(F.split(T.collapse(F.col("text")), " "), 1, 3), " ")
    return table(spark, d, "documents").select("doc_id", T.is_name_like(head).alias("named"))


@query("SELECT lang, count(*) AS n, bool_and(coalesce(lang, '') = '' OR lower(lang) = 'en' OR starts_with(lower(lang), 'en-')) AS supported FROM documents GROUP BY lang")
def p12_language_gate(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.bool_and(T.language_supported(F.col("lang"))).alias("supported"))


@query(f"WITH {LINES} SELECT page_id, passage_ord, len(ss) AS n, ss[1] AS first, ss[-1] AS last FROM (SELECT *, {SENT} AS ss FROM lines)")
def p13_sentences(spark: S, d: str) -> DataFrame:
    ss = T.sentences(F.col("text"))
    return lines(spark, d).select("page_id", "passage_ord", F.size(ss).alias("n"), F.get(ss, F.lit(0)).alias("first"), F.try_element_at(ss, F.lit(-1)).alias("last"))


@query(f"SELECT regexp_replace(w, '(ing|ed|es|s)$', '') AS stem, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS w FROM documents) GROUP BY 1")
def p15_stems(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w")).withColumn("stem", T.stem(F.col("w")))
    each = rows.groupBy("stem", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"WITH {LINES}, {HYPE} SELECT page_id, passage_ord, array_to_string(list_transform(found, lambda x: x.at || ':' || x.term), ',') AS found FROM hyped WHERE len(found) > 0")
def p16_hype_terms(spark: S, d: str) -> DataFrame:
    rows = lines(spark, d).withColumn("found", T.hype_terms(F.col("text"), list(LEXICON))).where(F.size("found") > 0)
    return rows.select("page_id", "passage_ord", F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["at"].cast("string"), x["term"])), ",").alias("found"))


@query(f"WITH {LINES}, {HYPE} SELECT page_id, passage_ord, round(100.0 * len(found) / {W}, 6) AS density FROM hyped")
def p17_hype_density(spark: S, d: str) -> DataFrame:
    return lines(spark, d).select("page_id", "passage_ord", F.round(T.hype_density(F.col("text"), list(LEXICON)), 6).alias("density"))


def sql_kind() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i)\\b(?:{p})\\b') THEN '{k}'" for k, p, _ in FAMILIES) + " END"


def sql_evidence() -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{k}' END" for k, p in PROOF) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {LINES} SELECT page_id, passage_ord, {sql_kind()} AS claim, array_to_string({sql_evidence()}, ',') AS evidence FROM lines")
def p18_p19_claims_evidence(spark: S, d: str) -> DataFrame:
    return lines(spark, d).select("page_id", "passage_ord", T.claim_kind(F.col("text"), FAMILIES).alias("claim"), F.array_join(T.evidence_kinds(F.col("text"), PROOF), ",").alias("evidence"))


@query(rf"""WITH {LINES} SELECT page_id, passage_ord, CASE {" ".join(f"WHEN regexp_matches(text, '(?i)[[:<:]](?:{p})[[:>:]]') THEN '{k}'" for k, p, _ in rules.CLAIMS)} END AS claim FROM lines""".replace("[[:<:]]", r"\b").replace("[[:>:]]", r"\b"))
def p18_english_claims(spark: S, d: str) -> DataFrame:
    return lines(spark, d).select("page_id", "passage_ord", T.claim_kind(F.col("text")).alias("claim"))


CTA = {"vague": r"^(the|and|de|la)[.,]?$", "action": "of|to|que|in", "nav": r"^(is|was|der)\.?$"}


@query(f"""WITH {NAV_LINKS} SELECT page_id, link_ord, text, CASE WHEN regexp_matches(text, '(?i){CTA["vague"]}') THEN 'vague' WHEN regexp_matches(text, '(?i)\\b(?:{CTA["action"]})\\b') THEN 'action' END AS cta
FROM (SELECT page_id, link_ord, href, trim(text) AS text FROM links) WHERE text != '' AND length(text) <= 60 AND NOT regexp_matches(text, '(?i){CTA["nav"]}') QUALIFY row_number() OVER (PARTITION BY page_id, lower(text), href ORDER BY link_ord) = 1""")
def p20_ctas(spark: S, d: str) -> DataFrame:
    return C.ctas(nav_links(spark, d), **CTA).select("page_id", "link_ord", "text", "cta")


@query(f"""WITH {NAV_LINKS}, judged AS (SELECT *, CASE WHEN regexp_matches(text, '(?i){CTA["vague"]}') THEN 'vague' WHEN regexp_matches(text, '(?i)\\b(?:{CTA["action"]})\\b') THEN 'action' END AS cta
FROM links WHERE trim(text) != '' AND NOT regexp_matches(trim(text), '(?i){CTA["nav"]}') QUALIFY row_number() OVER (PARTITION BY page_id, lower(text), href ORDER BY link_ord) = 1),
n AS (SELECT page_id, count(*) FILTER (cta = 'vague') AS vague, count(*) FILTER (cta = 'action') AS actions, list('“' || text || '”' ORDER BY link_ord) FILTER (cta = 'vague') AS said FROM judged GROUP BY page_id)
SELECT page_id, 'vague_cta' AS check_id, 'count=' || vague || ';examples=' || array_to_string(said[:3], ', ') AS slots FROM n WHERE vague > 0 UNION ALL SELECT page_id, 'no_clear_action', '' FROM n WHERE actions = 0""")
def d08_cta_signals(spark: S, d: str) -> DataFrame:
    return with_slots(C.cta_signals(nav_links(spark, d), **CTA))


def with_slots(signals: DataFrame) -> DataFrame:
    told = F.array_join(F.transform(F.array_sort(F.map_entries("slots")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return signals.select("page_id", "check_id", told.alias("slots"))


@query("SELECT page_id, replace(replace('Page {page} of {host}, {page}: {unknown}', '{page}', page_id::VARCHAR), '{host}', " + HOST + ") AS told FROM pages")
def p23_template_fill(spark: S, d: str) -> DataFrame:
    slots = F.create_map(F.lit("page"), F.col("page_id").cast("string"), F.lit("host"), host(F.col("url")))
    return table(spark, d, "pages").select("page_id", T.filled(F.lit("Page {page} of {host}, {page}: {unknown}"), slots).alias("told"))


@query(f"WITH {LINES} SELECT page_id, passage_ord, CASE WHEN length(text) > 240 THEN rtrim(text[:240]) || '…' ELSE text END AS quote FROM lines")
def p24_quotes(spark: S, d: str) -> DataFrame:
    return lines(spark, d).select("page_id", "passage_ord", T.quote(F.col("text")).alias("quote"))


@query(f"WITH {LINES} SELECT page_id, passage_ord, true AS own, coalesce(contains(next, CASE WHEN length(text) > 240 THEN rtrim(text[:240]) ELSE text END), false) AS of_next FROM (SELECT *, lead(text) OVER (PARTITION BY page_id ORDER BY passage_ord) AS next FROM lines)")
def p25_quote_verify(spark: S, d: str) -> DataFrame:
    rows = lines(spark, d).withColumn("next", F.lead("text").over(Window.partitionBy("page_id").orderBy("passage_ord"))).withColumn("quote", T.quote(F.col("text")))
    return rows.select("page_id", "passage_ord", T.is_quoted(F.col("text"), F.col("quote")).alias("own"), F.coalesce(T.is_quoted(F.col("next"), F.col("quote")), F.lit(False)).alias("of_next"))


SAID = "text || ' Authorization: Bearer abcdefghijklmnop' || doc_id || ' key-' || md5(doc_id::VARCHAR) || ' ?a=1&token=' || doc_id || '&b=2'"


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(s, '(?i)\bBearer\s+[A-Za-z0-9._\-]{{16,}}', 'Bearer [redacted]', 'g'), '(?i)\b(sk|key|tok)[-_][A-Za-z0-9._\-]{{16,}}', '[redacted]', 'g'), '(?i)([?&](?:api[-_]?key|key|token)=)[^&\s]+', '\1[redacted]', 'g')) AS digest FROM (SELECT doc_id, {SAID} AS s FROM documents)""")
def p06_redaction(spark: S, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    said = F.concat("text", F.lit(" Authorization: Bearer abcdefghijklmnop"), i, F.lit(" key-"), F.md5(i.cast("binary")), F.lit(" ?a=1&token="), i, F.lit("&b=2"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.redacted(said).cast("binary")).alias("digest"))


@query(f"WITH {LINES}, {HYPE} SELECT page_id, passage_ord, array_to_string(list_filter(list_transform(found, lambda x: x.term), lambda t: contains(lower(text[:40]), t)), ',') AS visible FROM hyped WHERE len(found) > 0")
def p32_visible_terms(spark: S, d: str) -> DataFrame:
    seen = F.filter(F.transform("found", lambda x: x["term"]), lambda t: F.contains(F.lower(F.left("text", F.lit(40))), t))
    return lines(spark, d).withColumn("found", T.hype_terms(F.col("text"), list(LEXICON))).where(F.size("found") > 0).select("page_id", "passage_ord", F.array_join(seen, ",").alias("visible"))


HIGHLIGHTED = ("thend", "with", "the")


@query(rf"WITH {LINES} SELECT page_id, passage_ord, array_to_string(list_transform(regexp_extract_all(text, '[\p{{L}}-]+|[^\p{{L}}-]+'), lambda x: CASE WHEN lower(x) IN {HIGHLIGHTED} THEN '<mark>' || x || '</mark>' ELSE x END), '') AS marked FROM lines")
def p33_highlights(spark: S, d: str) -> DataFrame:
    """Terms without a letter or hyphen next to them, in all lines."""
    return lines(spark, d).select("page_id", "passage_ord", T.highlighted(F.col("text"), HIGHLIGHTED).alias("marked"))


@query(f"WITH {PAGES} SELECT a.page_id, md5(lower(concat_ws(' ', title, '', h.text, p.text))) AS digest FROM arts a JOIN heads h USING (page_id) LEFT JOIN (SELECT page_id, string_agg(text, ' ' ORDER BY passage_ord) AS text FROM paras GROUP BY page_id) p USING (page_id)")
def p39_haystack(spark: S, d: str) -> DataFrame:
    return extracted(spark, d).select("page_id", F.md5(haystack().cast("binary")).alias("digest"))


def haystack():
    texts = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), " ")
    some = lambda c: F.when(F.size(c) > 0, texts(c))
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("meta_description", F.lit("")), some("headings"), some("passages")))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 8)[:3], '|') AS focus FROM documents")
def p41_focus_lines(spark: S, d: str) -> DataFrame:
    rows = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 8)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(rows, 1, 3), "|").alias("focus"))


@query(f"WITH {PAGES} SELECT page_id, string_agg(text, ' ' ORDER BY passage_ord)[:1200] AS opening FROM paras WHERE passage_ord < 3 GROUP BY page_id")
def p42_opening(spark: S, d: str) -> DataFrame:
    first = F.filter("passages", lambda p: p["section_ord"] == F.get("passages", F.lit(0))["section_ord"])
    opening = F.left(F.array_join(F.transform(F.slice(first, 1, 3), lambda p: p["text"]), " "), F.lit(1200))
    return extracted(spark, d).where(F.size("passages") > 0).select("page_id", opening.alias("opening"))


@query("SELECT page_id, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296))), 8, '0') AS hash FROM pages")
def p43_fnv_hash(spark: S, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.fnv1a(F.col("url")).alias("hash"))


# Addresses -----------------------------------------------------------------------------------------------------------

MADE = ["'HTTPS://' || upper(regexp_extract(url, '://([^/?#]*)', 1)) || ':443' || rest || '#x'", "url", "regexp_extract(url, '://([^/?#]*)', 1) || rest", "'http://127.0.0.1/a'", "'http://0x7f.1/'", "'https://2130706433'", "'https://localhost/x'", "'https://printer.local/'", "'https://[::1]/'", "'https://me:pw@' || regexp_extract(url, '://([^/?#]*)', 1) || '/'", "'ftp://example.com/f'", "'http://8.8.8.8/'", "'http://0300.0250.1.1/'"]
WHY = ["NULL", "NULL", "NULL", "'ip_private'", "'ip_private'", "'ip_private'", "'host'", "'suffix'", "'ipv6'", "'credentials'", "'scheme'", "'ip'", "'ip_private'"]


def made_urls(spark: S, d: str) -> DataFrame:
    u, h = F.col("url"), F.regexp_extract("url", "://([^/?#]*)", 1)
    rest = F.regexp_extract("url", r"://[^/?#]*([^#]*)", 1)
    forms = [F.concat(F.lit("HTTPS://"), F.upper(h), F.lit(":443"), rest, F.lit("#x")), u, F.concat(h, rest), *[F.lit(x.strip("'")) for x in MADE[3:9]], F.concat(F.lit("https://me:pw@"), h, F.lit("/")), *[F.lit(x.strip("'")) for x in MADE[10:]]]
    return table(spark, d, "pages").select("page_id", F.element_at(F.array(*forms), (F.col("page_id") % len(forms) + 1).cast("int")).alias("given"))


@query(f"""SELECT page_id, [{', '.join(WHY)}][page_id % {len(WHY)} + 1] AS refused,
CASE page_id % {len(WHY)} WHEN 0 THEN 'https://' || {HOST} || rest WHEN 1 THEN regexp_replace(url, '#.*$', '') WHEN 2 THEN 'https://' || {HOST} || rest END AS normal
FROM (SELECT *, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS rest FROM pages)""")
def p01_p02_p03_urls(spark: S, d: str) -> DataFrame:
    return made_urls(spark, d).select("page_id", I.refusal(F.col("given")).alias("refused"), I.normalized(F.col("given")).alias("normal"))


@query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'credentials' WHEN 2 THEN 'ip_private' END AS refused,
CASE page_id % 4 WHEN 2 THEN NULL WHEN 3 THEN regexp_extract(url, '^([a-z]+://)', 1) || {HOST} || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') END AS address,
CASE page_id % 4 WHEN 2 THEN 'http://127.0.0.1:8080' || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') WHEN 3 THEN regexp_extract(url, '^([a-z]+://)', 1) || {HOST} || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') END AS private
FROM pages""")
def p04_backend_addresses(spark: S, d: str) -> DataFrame:
    """Urls of pages as they are, without a scheme, with credentials and on this machine."""
    rest = F.regexp_extract("url", "://(.*)", 1)
    path = F.regexp_extract("url", "://[^/?#]*(.*)", 1)
    given = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("//"), rest)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://me:it@"), rest)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("http://127.0.0.1:8080"), path)).otherwise(F.col("url"))
    address, why = I.backend(F.col("given"))
    return table(spark, d, "pages").select("page_id", given.alias("given")).select("page_id", why.alias("refused"), address.alias("address"), I.backend(F.col("given"), True)[0].alias("private"))


@query(f"SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS site, regexp_matches(url, '(?i)\\.(jpe?g|png|gif|webp|svg|pdf|zip|mp4|mp3|css|js|xml|json)(\\?|$)') AS asset FROM pages")
def s07_url_filters(spark: S, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", I.site(host(F.col("url"))).alias("site"), I.is_asset(F.col("url")).alias("asset"))


@query("SELECT page_id, u FROM (SELECT page_id, regexp_replace(url, '[0-9]+.*$', '') AS u FROM pages) QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(u, '/$', '')) ORDER BY page_id) = 1")
def s08_url_dedupe(spark: S, d: str) -> DataFrame:
    return I.distinct_urls(table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[0-9]+.*$", "").alias("u")), "u", ["page_id"])


@query("SELECT page_id, octet_length(encode(html)) AS total_bytes, least(octet_length(encode(html)), 9000) AS kept_bytes, octet_length(encode(html)) > 9000 AS truncated FROM pages")
def s02_capped_body(spark: S, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in I.capped_body(F.col("html"), 9000).items()])


ROBOTS = ("User-agent: other", "Disallow: /", "", "User-agent: *", "User-Agent: third", "Disallow: /en/ # closed", "Allow: /en/1", "Disallow:", "Disallow: /de/2:x", "Allow: /en/2", "User-agent: fourth", "Disallow: /fr")


@query(f"""WITH u AS (SELECT page_id, {HOST} AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages), best AS (
SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(allow, length(rule)) AS allow FROM u JOIN (VALUES ('/en/', false), ('/en/1', true), ('/de/2:x', false), ('/en/2', true)) r(rule, allow) ON starts_with(path, rule) WHERE hash(host) IS NOT NULL GROUP BY page_id)
SELECT page_id, coalesce(allow, true) AS allowed, CASE WHEN NOT allow THEN 'robots.txt disallows ' || rule END AS reason FROM u LEFT JOIN best USING (page_id)""")
def s03_s04_robots(spark: S, d: str) -> DataFrame:
    u = table(spark, d, "pages").select("page_id", host(F.col("url")).alias("host"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    robots = u.select("host").distinct().withColumn("body", F.lit("\n".join(ROBOTS)))
    return I.robots_allowed(u, I.robots_rules(robots)).select("page_id", "allowed", "reason")


@query(f"SELECT {HOST} AS host, 'urlset' AS kind, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS ord, url FROM pages")
def s05_s06_sitemaps(spark: S, d: str, stretch: int = 4096) -> DataFrame:
    """A host's sitemap, as texts of at most a stretch of ids each, so that no text or task grows with a host; its entries are
    numbered over all of them."""
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    one = F.concat(F.lit("<url><loc> "), escaped, F.lit(" </loc></url>"))
    part = [host(F.col("url")).alias("host"), F.floor(F.col("page_id") / stretch).alias("part")]
    rows = table(spark, d, "pages").groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("page_id", one.alias("x")))).alias("xs"))
    maps = rows.select("host", "part", F.concat(F.lit("<urlset>"), F.array_join(F.transform("xs", lambda x: x["x"]), "\n"), F.lit("</urlset>")).alias("body"))
    sizes = table(spark, d, "pages").groupBy(*part).agg(F.count("url").alias("n"))
    before = sizes.select("host", "part", (F.sum("n").over(Window.partitionBy("host").orderBy("part")) - F.col("n")).alias("before"))
    return I.sitemap_urls(maps).join(before, ["host", "part"]).select("host", "kind", (F.col("before") + F.col("ord")).cast("int").alias("ord"), "url")

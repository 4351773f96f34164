"""Views of the tables that queries share, and the same views as SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import extract as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as passages of one section each: page_id, passage_ord, section_ord, kind, text, lang. White space is
    collapsed before the explode: after it, the filter on lengths and the column would each do so."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "lang", F.posexplode(F.transform(F.split("text", "\n"), T.collapse)).alias("passage_ord", "text"))
    return d.select("page_id", "passage_ord", F.lit(0).alias("section_ord"), F.lit("paragraph").alias("kind"), "text", "lang", F.lit(False).alias("boilerplate")).where(F.length("text") >= 2)


LINES = r"""
lines AS (
  SELECT doc_id AS page_id, passage_ord, 0 AS section_ord, 'paragraph' AS kind, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text, lang
  FROM (SELECT doc_id, lang, unnest(l) AS raw, unnest(range(len(l))) AS passage_ord FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))
  WHERE length(trim(regexp_replace(raw, '\s+', ' ', 'g'))) >= 2
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations as passages, turns as sections: page_id, section_ord, passage_ord, kind, text."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("section_ord"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    rows = c.select("page_id", "section_ord", (F.col("section_ord") * 1000 + F.col("at")).alias("passage_ord"), F.lit("paragraph").alias("kind"), T.collapse(F.col("raw")).alias("text"))
    return X.boilerplate(rows.where(F.length("text") >= 2))


TURNS = r"""
raw_turns AS (
  SELECT conv_id AS page_id, turn::INT AS section_ord, turn::INT * 1000 + pos AS passage_ord, 'paragraph' AS kind, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text
  FROM (SELECT conv_id, turn, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations))
  WHERE length(trim(regexp_replace(raw, '\s+', ' ', 'g'))) >= 2
), spread AS (SELECT page_id, text[:160] AS prefix, count(DISTINCT section_ord) AS n FROM raw_turns GROUP BY ALL),
turns AS (SELECT t.*, n >= 2 AS boilerplate FROM raw_turns t JOIN spread s ON t.page_id = s.page_id AND t.text[:160] = s.prefix)"""


def turn_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sections: a heading (the first three words of the turn) and its level by the turn."""
    c = table(spark, sf_dir, "conversations")
    heading = F.array_join(F.slice(F.split(T.collapse(F.col("text")), " "), 1, 3), " ")
    return c.select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("section_ord"), heading.alias("heading"), (F.length("text") % 4 + 1).alias("level"))


TURN_SECTIONS = r"""
turn_sections AS (
  SELECT conv_id AS page_id, turn::INT AS section_ord, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[:3], ' ') AS heading, length(text) % 4 + 1 AS level FROM conversations
)"""


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract(table(spark, sf_dir, "pages"))


PAGES = r"""
arts AS (
  SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS art, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    replace(replace(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')), '&amp;', '&'), '&quot;', '"') AS title
  FROM pages
), heads AS (
  SELECT page_id, 0 AS ord, 1 AS level, replace(replace(trim(regexp_replace(regexp_replace(regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '&amp;', '&'), '&quot;', '"') AS text, 1 AS section_ord FROM arts
), cut AS (
  SELECT page_id, pos, replace(replace(trim(regexp_replace(regexp_replace(string_split(part, '</p>')[1], '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '&amp;', '&'), '&quot;', '"') AS text
  FROM (SELECT page_id, unnest(l[2:]) AS part, unnest(range(len(l) - 1)) AS pos FROM (SELECT page_id, string_split(art, '<p>') AS l FROM arts))
), paras AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS passage_ord, 1 AS section_ord, 'paragraph' AS kind, text FROM cut WHERE length(text) >= 2
), sizes AS (
  SELECT page_id, length(regexp_replace(regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) + coalesce(n, 0) AS text_chars, length(array_to_string(regexp_extract_all(html, '(?s)<(?:script|style|template)[^>]*>(.*?)</(?:script|style|template)>', 1), '')) AS script_chars
  FROM arts LEFT JOIN (
    SELECT page_id, sum(length(regexp_replace(string_split(part, '</p>')[1], '<[^>]*>', '', 'g'))) AS n FROM (SELECT page_id, unnest(string_split(art, '<p>')[2:]) AS part FROM arts) GROUP BY page_id
  ) USING (page_id)
)"""


def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anchors of the raw pages, those in navigation too: page_id, link_ord, href, text."""
    p = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    rows = p.select("page_id", F.posexplode(found).alias("link_ord", "a"))
    return rows.select("page_id", "link_ord", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("text"))


NAV_LINKS = r"""
links AS (
  SELECT page_id, link_ord, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS text
  FROM (SELECT page_id, unnest(l) AS a, unnest(range(len(l))) AS link_ord FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages))
)"""


def digit(c: Column, nth: int) -> Column:
    """The nth hex digit of the md5 of a value, as a number: what synthetic decisions are made of."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(c.cast("string").cast("binary")), nth, 1)) - 1


def sql_digit(c: str, nth: int) -> str:
    return f"(strpos('0123456789abcdef', substr(md5(({c})::VARCHAR), {nth}, 1)) - 1)"


def sql_rows(rows: Iterable[tuple[str, ...]]) -> str:
    """Rows of strings as SQL's VALUES has them."""
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))


HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page summaries by registered domain, with synthetic judgements."""
    p = table(spark, sf_dir, "pages")
    d = lambda n: digit(F.col("page_id"), n)
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (d(n) % len(values) + 1).cast("int"))
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return p.select(
        F.regexp_extract(host(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("site"), F.col("page_id").alias("ord"), "url", pick(("sell", "explain", "sell", "support"), 1).alias("purpose"), pick(("saas", "agency", "publisher"), 2).alias("business_type"),
        F.slice(F.array_distinct(F.regexp_extract_all(title, F.lit(r"\p{L}{2,}"), F.lit(0))), 1, 8).alias("terms"), F.when(d(3) < 12, d(3) < 3).alias("audience_named"), (d(4) < 7).alias("has_action"),
        pick(("awareness", "decision", "purchase", "none"), 5).alias("stage"), F.when(d(6) < 10, F.array(F.lit("q_what_it_costs"), F.lit("q_support"))).alias("raised"), F.when(d(7) < 4, F.array(F.lit("q_support"))).alias("answered"),
    )


def _pick(values: tuple[str, ...], n: int) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{sql_digit('page_id', n)} % {len(values)} + 1]"


SUMMARIES = rf"""
summaries AS (
  SELECT regexp_extract({HOST}, '([^.]+\.[^.]+)$', 1) AS site, page_id AS ord, url, {_pick(("sell", "explain", "sell", "support"), 1)} AS purpose, {_pick(("saas", "agency", "publisher"), 2)} AS business_type,
    regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\p{{L}}{{2,}}') AS all_terms,
    CASE WHEN {sql_digit("page_id", 3)} < 12 THEN {sql_digit("page_id", 3)} < 3 END AS audience_named, {sql_digit("page_id", 4)} < 7 AS has_action, {_pick(("awareness", "decision", "purchase", "none"), 5)} AS stage,
    CASE WHEN {sql_digit("page_id", 6)} < 10 THEN ['q_what_it_costs', 'q_support'] END AS raised, CASE WHEN {sql_digit("page_id", 7)} < 4 THEN ['q_support'] END AS answered
  FROM pages
)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic answers about turns as sections, four questions each."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    asked = c.select(F.col("conv_id").alias("page_id"), F.col("turn").cast("string").alias("ref_id"), key.alias("key"), F.posexplode(F.array(*[F.lit(q) for q in ("answers_heading", "self_contained", "extraction_readiness", "promotional_intensity")])).alias("n", "question_id"))
    a, b = (digit(F.col("key") * 10 + F.col("n"), k) for k in (1, 2))
    atype = F.when(F.col("n") < 2, "noul").when(F.col("n") == 2, "choice").otherwise("score")
    options = F.array(F.lit("ready"), F.lit("needs_context"), F.lit("buried"), F.lit("absent"))
    return asked.select(
        "page_id", F.lit("section").alias("scope"), "ref_id", "question_id", atype.alias("atype"), F.when(atype == "noul", a / 15.0).alias("noul"), F.when(atype == "choice", F.element_at(options, (a % 4 + 1).cast("int"))).alias("choice"),
        F.when(atype == "score", a / 3.0).alias("score"), F.when(atype == "choice", 4).otherwise(2).alias("n_options"), F.when(atype != "noul", b / 15.0).alias("confidence"),
    )


ANSWERS = rf"""
asked AS (
  SELECT conv_id AS page_id, 'section' AS scope, turn::VARCHAR AS ref_id, (conv_id * 100 + turn) * 10 + n AS k, n, ['answers_heading', 'self_contained', 'extraction_readiness', 'promotional_intensity'][n + 1] AS question_id
  FROM conversations, range(4) r(n)
), answers AS (
  SELECT page_id, scope, ref_id, question_id, CASE WHEN n < 2 THEN 'noul' WHEN n = 2 THEN 'choice' ELSE 'score' END AS atype, CASE WHEN n < 2 THEN {sql_digit("k", 1)} / 15.0::DOUBLE END AS noul,
    CASE WHEN n = 2 THEN ['ready', 'needs_context', 'buried', 'absent'][{sql_digit("k", 1)} % 4 + 1] END AS choice, CASE WHEN n = 3 THEN {sql_digit("k", 1)} / 3.0::DOUBLE END AS score,
    CASE WHEN n = 2 THEN 4 ELSE 2 END AS n_options, CASE WHEN n >= 2 THEN {sql_digit("k", 2)} / 15.0::DOUBLE END AS confidence
  FROM asked
), sure AS (
  SELECT * REPLACE (coalesce(confidence, least(1.0, abs(noul - 0.5) * 2), 0.0) AS confidence) FROM answers
), confident AS (
  SELECT * FROM sure WHERE confidence >= CASE atype WHEN 'choice' THEN CASE WHEN n_options <= 2 THEN 0.6 ELSE greatest(0.35, least(0.6, 2.0 / n_options)) END WHEN 'score' THEN 0.5 ELSE 0.6 END
)"""

"""Queries of request bodies, responses, plan texts and section names, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.operators import bodies as B
from pagewright.operators import report as P
from pagewright.operators import responses as V
from pagewright.operators import site as R

from .registry import SQL, query
from .site_queries import job_findings
from .views import TURN_SECTIONS, digit, sql_digit, sql_rows, table, turn_sections

S = SparkSession


def site_bodies(spark: S, d: str) -> DataFrame:
    """Bodies made of documents, some 22 or 8 in each: some broken, too many, or with an item that isn't right."""
    k = F.col("doc_id")
    wrong = F.when(digit(k, 3) < 2, digit(k, 2))
    rows = table(spark, d, "documents").select(
        (F.floor(k / 30) * 2 + F.when(digit(k, 1) < 12, 0).otherwise(1)).alias("body_id"), "doc_id", wrong.alias("wrong"), F.concat(F.lit("https://example.com/"), k.cast("string")).alias("url"),
        F.when(digit(k, 4) < 8, "sell").alias("purpose"), digit(k, 5).alias("high"), (digit(k, 6) < 4).alias("found"),
    )
    none = F.lit(None).cast("string")
    summary = F.struct(
        "url", none.alias("title"), "purpose", none.alias("businessType"), F.array(F.lit("one"), F.lit("two")).alias("topicTerms"), F.lit(None).cast("boolean").alias("audienceNamed"), F.lit(True).alias("hasAction"), none.alias("journeyStage"),
        F.struct((F.col("high") + 2).alias("count"), "high").alias("findingCounts"), F.when(F.col("high") > 7, F.struct(F.array(F.lit("q_support")).alias("raised"), F.array().cast("array<string>").alias("answered"))).alias("coverage"),
    )
    page = F.to_json(summary, {"ignoreNullFields": "false"})
    page = F.when(F.col("wrong") == 0, F.replace(page, F.lit('"hasAction":true'), F.lit('"hasAction":"true"'))).when(F.col("wrong") == 1, F.regexp_replace(page, '"high":', '"high":-1')).when(F.col("wrong") == 2, F.replace(page, F.lit('"title":null,'), F.lit(""))).otherwise(page)
    outcome = F.to_json(F.struct(F.lit("f1").alias("id"), F.lit("We help small teams").alias("text"), F.col("url").alias("pageUrl"), "found"))
    finding = F.to_json(F.struct(F.concat(F.lit("vague_claim:"), k.cast("string")).alias("id"), F.lit("vague_claim").alias("checkId"), F.when(F.col("wrong") == 3, "misc").otherwise("evidence_trust").alias("module"), F.col("url").alias("pageUrl")))
    each = rows.select("body_id", F.struct("doc_id", page.alias("page"), outcome.alias("outcome"), finding.alias("finding")).alias("x"))
    whole = each.groupBy("body_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    joined = lambda n: F.array_join(F.transform("x", lambda x: x[n]), ",")
    k = digit(F.col("body_id"), 1)
    said = F.when(k == 1, F.lit('"none"')).otherwise(F.concat(F.lit("["), joined("outcome"), F.lit("]")))
    body = F.concat(F.lit('{"summaries":['), joined("page"), F.lit("]"), F.when(k == 2, "").otherwise(F.concat(F.lit(',"focus":'), said)), F.lit(',"findings":['), joined("finding"), F.lit("]"), F.when(k == 0, "").otherwise("}"))
    return whole.select("body_id", body.alias("body"))


K, W = sql_digit("body_id", 1), f"CASE WHEN {sql_digit('doc_id', 3)} < 2 THEN {sql_digit('doc_id', 2)} END"
REQUESTS = f"""
items AS (SELECT doc_id // 30 * 2 + CASE WHEN {sql_digit("doc_id", 1)} < 12 THEN 0 ELSE 1 END AS body_id, doc_id, coalesce({W}, 9) AS wrong, {sql_digit("doc_id", 5)} AS high, {sql_digit("doc_id", 6)} < 4 AS found FROM documents),
counted AS (SELECT body_id, {K} AS k, count(*) AS n, sum(high) AS high, count_if(high > 7) AS raised, count_if(found) AS found, bool_or(wrong < 3) AS bad, bool_or(wrong = 3) AS odd FROM items GROUP BY body_id),
requests AS (
  SELECT *, CASE WHEN k = 0 THEN 'absent' WHEN n > 25 THEN 'too_many' WHEN bad THEN 'invalid' ELSE 'ok' END AS summaries_state, CASE WHEN k IN (0, 2) THEN 'absent' WHEN k = 1 THEN 'invalid' WHEN n > 75 THEN 'too_many' ELSE 'ok' END AS outcomes_state,
    CASE WHEN k = 0 THEN 'absent' WHEN n > 500 THEN 'too_many' WHEN odd THEN 'invalid' ELSE 'ok' END AS findings_state
  FROM counted
)"""


@query(f"""WITH {REQUESTS} SELECT body_id, CASE WHEN summaries_state = 'ok' THEN 200 ELSE 400 END AS status, summaries_state, outcomes_state, findings_state, summaries_state = 'ok' AND n >= 3 AS enough,
  CASE WHEN summaries_state = 'ok' THEN n ELSE 0 END AS pages, CASE WHEN summaries_state = 'ok' THEN high ELSE 0 END::BIGINT AS high, CASE WHEN summaries_state = 'ok' THEN raised ELSE 0 END AS raised,
  CASE WHEN outcomes_state = 'ok' THEN found ELSE 0 END AS found, CASE WHEN findings_state = 'ok' THEN n ELSE 0 END AS findings FROM requests""")
def s09_site_requests(spark: S, d: str) -> DataFrame:
    r = B.site_requests(site_bodies(spark, d))
    size = lambda c: F.size(c).cast("long")
    high = F.aggregate("summaries", F.lit(0).cast("long"), lambda a, x: a + x["high"])
    return r.select(
        "body_id", "status", "summaries_state", "outcomes_state", "findings_state", "enough", F.col("pages").cast("long").alias("pages"), high.alias("high"), size(F.filter("summaries", lambda x: F.size(x["raised"]) > 0)).alias("raised"),
        size(F.filter("outcomes", lambda x: x["found"])).alias("found"), size("findings").alias("findings"),
    )


@query(f"""WITH {REQUESTS}, answered AS (SELECT * FROM requests WHERE summaries_state = 'ok' AND n >= 3)
SELECT body_id AS site, 'recurring:vague_claim' AS job_id, n AS pages FROM answered WHERE findings_state = 'ok' AND n >= 3
UNION ALL SELECT body_id, 'site:site_sells_without_explaining:site', 0 FROM answered JOIN (SELECT body_id, count_if({sql_digit("doc_id", 4)} < 8) AS sell FROM items GROUP BY body_id) USING (body_id) WHERE sell > 0.7::DOUBLE * n
UNION ALL SELECT body_id, 'site:audience_rarely_named:site', 0 FROM answered
UNION ALL SELECT body_id, 'site:question_unanswered_sitewide:q_support', 0 FROM answered WHERE raised > 0""")
def s09_site_answers(spark: S, d: str) -> DataFrame:
    """The plan that each body's site gets."""
    r = B.site_requests(site_bodies(spark, d))
    _, plan = B.site_answers(r, rules.checks(spark), rules.questions(spark), rules.question_texts(spark), rules.stage_texts(spark))
    return plan.select("site", "job_id", F.size("pages").cast("long").alias("pages"))


def page_bodies(spark: S, d: str) -> DataFrame:
    """Bodies about one page, of events: addresses of several kinds, focuses of several lengths."""
    k = F.col("event_id")
    a, b = digit(k, 1), digit(k, 2)
    url = F.when(a == 0, "null").when(a == 1, "17").when(a == 2, '""').when(a == 3, '"http://127.0.0.1/x"').when(a == 4, '"ftp://example.com/"').otherwise(F.concat(F.lit('" Example.com/e/'), k.cast("string"), F.lit('#top "')))
    focus = F.when(b == 0, "null").when(b == 1, '"We help small teams"').when(b == 2, '["  short  ", 4, null, "We help small teams", "We help small teams "]').when(b == 3, '["We help one", "We help two", "We help three", "We help four"]').otherwise('["We help small teams"]')
    part = F.when(b < 4, "true").when(b < 8, '"true"').when(b < 12, "1").otherwise("false")
    return table(spark, d, "events").select(k.alias("body_id"), F.concat(F.lit('{"url":'), url, F.lit(',"focus":'), focus, F.lit(',"partOfScan":'), part, F.lit("}")).alias("body"))


@query(f"""WITH e AS (SELECT event_id, {sql_digit("event_id", 1)} AS a, {sql_digit("event_id", 2)} AS b FROM events)
SELECT event_id AS body_id, CASE WHEN a > 4 THEN 'https://example.com/e/' || event_id END AS url, CASE WHEN a <= 2 OR a = 4 THEN 'invalid_url' WHEN a = 3 THEN 'blocked_url' END AS error_code,
  CASE WHEN b < 2 THEN '' WHEN b = 3 THEN 'We help one|We help two|We help three' ELSE 'We help small teams' END AS focuses, b < 4 AS part_of_scan FROM e""")
def s09_page_requests(spark: S, d: str) -> DataFrame:
    r = B.page_requests(page_bodies(spark, d))
    return r.select("body_id", "url", "error_code", F.array_join("focuses", "|").alias("focuses"), "part_of_scan")


TOLD = sql_rows([("recurring:" + c, x[0], x[1]) for c, x in rules.RECURRING_TEXTS.items()] + [("area:" + a, x[0], rules.AREA_REASON.replace("{area}", x[1])) for a, x in rules.AREA_TEXTS.items()] + [("site:" + c, *x) for c, x in rules.SITE_TEXTS.items()])


@query(f"""WITH jobs AS ({SQL["d19_a18_a20_opportunities"]}), told(job, title, reason) AS (VALUES {TOLD})
SELECT site, job_id, title, replace(reason, '{{n}}', CASE WHEN job_id LIKE 'area:%' THEN findings ELSE pages END::VARCHAR) AS reason FROM jobs JOIN told ON array_to_string(string_split(job_id, ':')[:2], ':') = job""")
def j13_plan_texts(spark: S, d: str) -> DataFrame:
    jobs = R.opportunities(job_findings(spark, d), rules.questions(spark))
    return R.plan_told(jobs, rules.plan_texts(spark)).select("site", "job_id", "title", "reason")


def section_of(key: Column, own: Column) -> Column:
    return F.when(digit(key, 2) < 3, F.lit(None).cast("int")).when(digit(key, 2) < 6, own + 1000).otherwise(own)


@query(f"""WITH {TURN_SECTIONS}, f AS (SELECT page_id, section_ord AS own, page_id * 100 + section_ord AS k FROM turn_sections),
placed AS (SELECT page_id, own, CASE WHEN {sql_digit("k", 2)} < 3 THEN NULL WHEN {sql_digit("k", 2)} < 6 THEN own + 1000 ELSE own END AS section_ord FROM f)
SELECT p.page_id, own, coalesce(nullif(heading, ''), 'Section ' || p.section_ord, 'This page') AS section FROM placed p LEFT JOIN turn_sections t ON t.page_id = p.page_id AND t.section_ord = p.section_ord""")
def j17_section_names(spark: S, d: str) -> DataFrame:
    """A finding about each turn, some about no section and some about one that isn't there."""
    sections = turn_sections(spark, d)
    findings = sections.select("page_id", F.col("section_ord").alias("own"), section_of(F.col("page_id") * 100 + F.col("section_ord"), F.col("section_ord")).alias("section_ord"))
    return P.section_names(findings, sections).select("page_id", "own", "section")


def responses(spark: S, d: str) -> DataFrame:
    """Responses about events, two answers each; some are broken or have a wrong value."""
    k = F.col("event_id")
    a, b = digit(k, 3), digit(k, 4)
    noul = F.when(a == 0, "1.5").otherwise((b / 16).cast("string"))
    kind = F.when(a == 1, "rating").otherwise("choice")
    sure = F.when(a == 2, ',"confidence":null').when(b < 8, F.concat(F.lit(',"confidence":'), (b / 8).cast("string"))).otherwise("")
    body = F.concat(
        F.lit('{"model":'), F.when(a == 5, "7").otherwise('"m"'), F.lit(',"answers":{"q_a":{"type":"noul","noul":'), noul, F.lit('},"q_b":{"type":"'), kind, F.lit('","choice":"yes","probabilities":{"yes":0.5,"no":1}'), sure,
        F.lit('}},"usage":{"input_tokens":'), F.when(a == 4, -1).otherwise(b).cast("string"), F.when(a == 3, "}").otherwise("}}"),
    )
    return table(spark, d, "events").select(k.alias("page_id"), F.lit("page").alias("scope"), F.lit("page").alias("ref_id"), body.alias("body"))


RESPONSES = f"""said AS (SELECT event_id, {sql_digit("event_id", 3)} AS a, {sql_digit("event_id", 4)} AS b FROM events)"""


@query(f"""WITH {RESPONSES} SELECT event_id AS page_id, CASE WHEN a > 5 THEN 'm' END AS model, CASE WHEN a > 5 THEN b::DOUBLE END AS input_tokens, CASE WHEN a > 5 THEN 0::DOUBLE END AS output_tokens,
  'malformed response: ' || CASE a WHEN 0 THEN 'answers.q_a.noul' WHEN 1 THEN 'answers.q_b.type' WHEN 2 THEN 'answers.q_b.confidence' WHEN 3 THEN '' WHEN 4 THEN 'usage.input_tokens' WHEN 5 THEN 'model' END AS reason FROM said""")
def s12_responses(spark: S, d: str) -> DataFrame:
    return V.validated(responses(spark, d)).select("page_id", "model", "input_tokens", "output_tokens", "reason")


@query(f"""WITH {RESPONSES} SELECT event_id AS page_id, 'q_a' AS question_id, 'noul' AS atype, b / 16::DOUBLE AS noul, NULL AS choice, NULL::INT AS n_options, abs(b / 16::DOUBLE - 0.5::DOUBLE) * 2 AS confidence FROM said WHERE a > 5
UNION ALL SELECT event_id, 'q_b', 'choice', NULL, 'yes', 2, CASE WHEN b < 8 THEN b / 8::DOUBLE ELSE 0 END FROM said WHERE a > 5""")
def s12_answers(spark: S, d: str) -> DataFrame:
    return V.answers(V.validated(responses(spark, d))).select("page_id", "question_id", "atype", "noul", "choice", "n_options", "confidence")

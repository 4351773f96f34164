"""Queries of report parts, profiles, states and request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions import text as T
from pagewright.operators import content as C
from pagewright.operators import extract as X
from pagewright.operators import findings as N
from pagewright.operators import report as P

from pagewright.operators import states as ST
from pagewright.sources.held import held
from pagewright.sources.sinks import NOTHING, page_reports

from .page_queries import CLAIMS, SECTION_TEXTS, STRUCTURE, TIERS, section_texts, structure
from .registry import SQL, query
from .site_queries import TERMS
from .text_queries import FAMILIES, HYPE, LEXICON, PROOF
from .views import HOST, LINES, PAGES, SUMMARIES, TURN_SECTIONS, TURNS, digit, extracted, lines, sql_digit, sql_rows, summaries, table, turn_sections, turns

S = SparkSession
KINDS = (*P.FIXES, "unknown")


@query(f"""WITH {LINES}, {HYPE}, t AS (SELECT page_id, passage_ord, list_transform(found[:3], lambda x: '“' || x.term || '”') AS q, [{', '.join(repr(k) for k in KINDS)}][{sql_digit('page_id', 1)} % {len(KINDS)} + 1] AS fix FROM hyped), f AS (SELECT *, CASE fix {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in P.FIXES.items())} ELSE '{P.FIXES["add_a_number"]}' END AS told FROM t)
SELECT page_id, passage_ord, CASE WHEN len(q) = 0 THEN told ELSE 'It leans on ' || CASE WHEN len(q) = 1 THEN q[1] ELSE array_to_string(q[:len(q) - 1], ', ') || ' and ' || q[-1] END || '. ' || told END AS suggestion FROM f""")
def p31_suggestions(spark: S, d: str) -> DataFrame:
    fix = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (digit(F.col("page_id"), 1) % len(KINDS) + 1).cast("int"))
    rows = lines(spark, d).withColumn("found", T.hype_terms(F.col("text"), list(LEXICON), 3))
    return rows.select("page_id", "passage_ord", P.suggestion(F.transform("found", lambda x: x["term"]), fix).alias("suggestion"))


@query("SELECT page_id, CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/$', '') END AS path, CASE page_id % 3 WHEN 0 THEN 'Now' WHEN 1 THEN 'Soon' ELSE 'Later' END AS label, CASE WHEN page_id % 3 = 1 THEN 'It is short.' ELSE 'It is short. (' || page_id % 3 || ' places)' END AS headline FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)")
def p34_labels(spark: S, d: str) -> DataFrame:
    n = F.col("page_id") % 3
    priority = F.when(n == 0, "high").when(n == 1, "medium").otherwise("low")
    return table(spark, d, "pages").select("page_id", P.short_path(F.col("url")).alias("path"), P.priority_label(priority).alias("label"), P.headline(F.lit("It is short."), n).alias("headline"))


@query(f"""SELECT page_id, 1 + (a % 2 = 0)::INT + (a % 3 = 0)::INT + (a % 5 = 0)::INT + (b % 4 > 0)::INT + (bytes > 9000)::INT + (b % 3 > 0)::INT + (a < b)::INT + (a > 12)::INT AS n
FROM (SELECT page_id, {sql_digit('page_id', 1)} AS a, {sql_digit('page_id', 2)} AS b, octet_length(encode(html)) AS bytes FROM pages)""")
def p35_limits(spark: S, d: str) -> DataFrame:
    a, b, size = digit(F.col("page_id"), 1), digit(F.col("page_id"), 2), F.octet_length("html")
    page = {"degraded": a % 2 == 0, "reason": F.lit(None).cast("string"), "split": a % 3 == 0, "lang": F.lit("de"), "supported": a % 5 != 0, "reviews": b % 4, "truncated": size > 9000, "kept_bytes": F.least(size, F.lit(9000)), "total_bytes": size, "cards": b % 3, "analysed": a, "sections": b, "js_likely": a > 12}
    return table(spark, d, "pages").select("page_id", F.size(P.limits(page)).alias("n"))


@query("SELECT page_id, 'Seen.' || chr(10) || 'The text:' || chr(10) || '> ' || url || chr(10) || 'Do it.' || chr(10) || 'Keep every fact as it stands.' AS prompt FROM pages")
def p40_fix_prompts(spark: S, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", P.fix_prompt(F.lit("Seen."), F.array("url"), F.lit("Do it.")).alias("prompt"))


@query(f"SELECT page_id, [{', '.join(str(v) for v in P.STATUS.values())}, 500][page_id % {len(P.STATUS) + 1} + 1] AS status FROM pages")
def p38_error_status(spark: S, d: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in P.STATUS], F.lit("other"))
    return table(spark, d, "pages").select("page_id", P.error_status(F.element_at(codes, (F.col("page_id") % (len(P.STATUS) + 1) + 1).cast("int"))).alias("status"))


@query("SELECT doc_id, CASE WHEN regexp_matches(w, '^[A-Za-z0-9._-]{20,400}$') THEN w END AS key, CASE WHEN regexp_matches(w, '^[A-Za-z0-9._/-]{1,80}$') THEN w END AS model, CASE WHEN doc_id % 2 = 0 THEN 'own' END AS backend FROM (SELECT doc_id, trim(split_part(text, ' ', 1)) || ' ' AS v, trim(split_part(text, ' ', 1)) AS w FROM documents)")
def p05_header_readers(spark: S, d: str) -> DataFrame:
    w = F.concat(F.substring_index("text", " ", 1), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", P.caller_key(w).alias("key"), P.caller_model(w).alias("model"), P.caller_backend(F.when(F.col("doc_id") % 2 == 0, " Own ").otherwise("x")).alias("backend"))


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 25")
def s09_request_bodies(spark: S, d: str) -> DataFrame:
    """Bodies made of events, parsed and capped at 25 a type."""
    bodies = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("body"))
    rows = bodies.select(P.parsed_body(F.col("body"), "event_id long, event_type string").alias("b")).select("b.*")
    return P.capped(rows, "event_id", 25, by="event_type")


@query(f"WITH {SECTION_TEXTS} SELECT page_id, 's' || section_ord AS ref_id, length(heading) + length(text) > 0 AS some FROM section_texts WHERE n_words >= 12 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n_words DESC, section_ord) <= 2")
def d16_section_states(spark: S, d: str) -> DataFrame:
    s = section_texts(spark, d)
    docs = s.select("page_id").distinct().withColumn("title", F.lit("t"))
    states = P.section_states(docs, s, most=2)
    read = F.from_json("state", "page_title string, heading string, heading_level int, text string")
    return states.select("page_id", "ref_id", (F.length(read["heading"]) + F.length(read["text"]) > 0).alias("some"))


@query(f"WITH {CLAIMS} SELECT c.page_id, c.passage_ord, md5(c.text || '|' || c.claim || '|' || l.text) AS digest FROM claims c JOIN lines l ON l.page_id = c.page_id AND l.passage_ord = c.support")
def d16_claim_states(spark: S, d: str) -> DataFrame:
    rows = lines(spark, d)
    states = P.claim_states(C.claims(rows, list(LEXICON), FAMILIES, PROOF), rows)
    read = F.from_json("state", "claim string, claim_is_about string, supporting_detail string")
    return states.select("page_id", F.col("ref_id").cast("int").alias("passage_ord"), F.md5(F.concat_ws("|", read["claim"], read["claim_is_about"], read["supporting_detail"]).cast("binary")).alias("digest"))


def said(rows: DataFrame, question, choice=None) -> DataFrame:
    """Synthetic answers about rows (page_id, ref_id), by their digits."""
    k = F.concat_ws(":", F.col("page_id").cast("string"), F.col("ref_id"), question)
    a, b = digit(k, 1), digit(k, 2)
    kind = F.lit("noul" if choice is None else "choice")
    return rows.select("page_id", F.lit("page").alias("scope"), "ref_id", question.alias("question_id"), kind.alias("atype"), (a / 15.0).alias("noul") if choice is None else F.lit(None).cast("double").alias("noul"), F.lit(None).cast("string").alias("choice") if choice is None else choice(a).alias("choice"), F.lit(None).cast("double").alias("score"), F.lit(4).alias("n_options"), F.lit(None).cast("double").alias("confidence") if choice is None else (b / 15.0).alias("confidence"))


def sql_said(k: str) -> str:
    return f"{sql_digit(k, 1)} / 15.0::DOUBLE AS noul, least(1.0, abs({sql_digit(k, 1)} / 15.0::DOUBLE - 0.5) * 2) AS sure, {sql_digit(k, 1)} AS a, {sql_digit(k, 2)} / 15.0::DOUBLE AS stated"


@query(f"WITH {CLAIMS}, x AS (SELECT page_id, passage_ord, claim, {sql_said("page_id || ':' || passage_ord || ':evidence_supports_claim'")} FROM claims WHERE distance > 0) SELECT page_id, passage_ord, claim, CASE WHEN sure >= 0.85 THEN 'high' ELSE 'medium' END AS confidence FROM x WHERE sure >= 0.6 AND noul < 0.5")
def d11_j07_irrelevant_evidence(spark: S, d: str) -> DataFrame:
    found = C.claims(lines(spark, d), list(LEXICON), FAMILIES, PROOF).where("distance > 0")
    asked = found.select("page_id", F.col("passage_ord").cast("string").alias("ref_id"))
    return P.irrelevant_evidence(found, said(asked, F.lit("evidence_supports_claim")))


@query(f"""WITH x AS (SELECT page_id, q, c, {sql_said("page_id || ':page:' || q")} FROM pages, (VALUES {', '.join(str(x) for x in P.MESSAGING.items())}) v(q, c)) SELECT page_id, c AS check_id, CASE WHEN sure >= 0.85 THEN 'high' ELSE 'medium' END AS confidence FROM x WHERE sure >= 0.6 AND noul < 0.5""")
def d12_messaging(spark: S, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.lit("page").alias("ref_id"), F.explode(F.array(*[F.lit(q) for q in P.MESSAGING])).alias("q"))
    return P.messaging(said(pages, F.col("q")))


@query(f"""WITH x AS (SELECT page_id, q, {sql_said("page_id || ':page:' || q")} FROM pages, (VALUES ('q_support'), ('q_free_tier')) v(q)) SELECT page_id, q AS question_id, a % 3 = 0 AS answered, CASE WHEN stated >= 0.85 THEN 'high' ELSE 'medium' END AS confidence FROM x WHERE stated >= 0.5 AND a % 3 < 2""")
def d13_page_coverage(spark: S, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.lit("page").alias("ref_id"), F.explode(F.array(F.lit("q_support"), F.lit("q_free_tier"))).alias("q"))
    options = F.array(F.lit("answers_it"), F.lit("mentions_only"), F.lit("not_addressed"))
    return P.page_coverage(said(pages, F.col("q"), lambda a: F.element_at(options, (a % 3 + 1).cast("int"))))


@query(f"""WITH {LINES}, short AS (SELECT page_id, 'p' || row_number() OVER (PARTITION BY page_id ORDER BY passage_ord) AS key, text FROM lines WHERE len(string_split_regex(text, '\\s+')) BETWEEN 8 AND 60 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY passage_ord) <= 8),
x AS (SELECT doc_id AS page_id, dim, {sql_said("doc_id || ':page:' || dim")} FROM documents, (VALUES {', '.join(f"('{x}')" for x in P.DIMENSIONS)}) v(dim)), c AS (SELECT page_id, dim, stated, CASE WHEN stated >= 0.5 AND a != 0 THEN 'p' || a END AS choice FROM x)
SELECT page_id, dim AS dimension, CASE WHEN dim = 'business_type' THEN choice END AS value, CASE WHEN dim != 'business_type' THEN text END AS quote, coalesce(CASE WHEN dim = 'business_type' THEN choice ELSE text END, '') = '' AS absent,
CASE WHEN CASE WHEN dim = 'business_type' THEN choice ELSE text END IS NOT NULL THEN CASE WHEN stated >= 0.85 THEN 'high' WHEN stated >= 0.65 THEN 'medium' ELSE 'low' END END AS confidence FROM c LEFT JOIN short ON c.page_id = short.page_id AND choice = key""".replace("SELECT page_id, dim AS dimension", "SELECT c.page_id AS page_id, dim AS dimension"))
def d14_profile(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit("page").alias("ref_id"))
    asked = docs.select("page_id", "ref_id", F.explode(F.array(*[F.lit(x) for x in P.DIMENSIONS])).alias("q"))
    answers = said(asked, F.col("q"), lambda a: F.when(a == 0, "not_stated").otherwise(F.concat(F.lit("p"), a.cast("string"))))
    return P.profile(docs, answers, C.shortlist(lines(spark, d)))


@query(f"SELECT page_id, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id % 3 DESC, page_id % 7 DESC, CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END, url) AS place FROM (SELECT *, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def o07_page_table(spark: S, d: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    rows = table(spark, d, "pages").select("page_id", "url", host.alias("site"), (F.col("page_id") % 3).alias("high"), (F.col("page_id") % 7).alias("findings"))
    return P.page_table(rows).select("page_id", F.col("place").cast("long").alias("place"))


@query("SELECT question_id, status, row_number() OVER (ORDER BY CASE status WHEN 'unanswered' THEN 0 WHEN 'absent' THEN 1 ELSE 2 END, question_id) AS place FROM (SELECT event_id AS question_id, ['answered', 'unanswered', 'absent'][event_id % 3 + 1] AS status FROM events)")
def o08_coverage_order(spark: S, d: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("answered"), F.lit("unanswered"), F.lit("absent")), (F.col("event_id") % 3 + 1).cast("int"))
    return P.coverage_order(table(spark, d, "events").select(F.col("event_id").alias("question_id"), status.alias("status")))


@query("SELECT provider, sum(calls) AS calls, sum(tokens) AS tokens, bool_or(degraded) AS degraded, arg_min(model, k) AS model FROM (SELECT user_id % 5 AS provider, event_id AS k, 1 AS calls, length(props) AS tokens, event_id % 97 = 0 AS degraded, CASE WHEN event_id % 3 = 0 THEN event_type END AS model FROM events) GROUP BY provider")
def a22_run_statistics(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("provider"), F.col("event_id").alias("k"), F.length("props").alias("tokens"), (F.col("event_id") % 97 == 0).alias("degraded"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("model"))
    first = F.min_by("model", F.when(F.col("model").isNotNull(), F.col("k")))
    return e.groupBy("provider").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.bool_or("degraded").alias("degraded"), first.alias("model"))


@query(f"""WITH s AS ({STRUCTURE}), m AS ({SQL["d12_messaging"]}), c AS ({SQL["d13_page_coverage"]}), f AS (
  SELECT page_id, check_id, 'high' AS confidence, check_id AS finding_id FROM s UNION ALL SELECT page_id, check_id, confidence, check_id FROM m
  UNION ALL SELECT page_id, 'question_raised_unanswered', confidence, 'question_raised_unanswered:' || question_id FROM c WHERE NOT answered
), n AS (SELECT *, {TIERS} AS tier, count(*) OVER (PARTITION BY page_id, check_id) AS occurrences, list_position(['high', 'medium', 'low'], confidence) AS sure FROM f)
SELECT page_id, check_id, confidence, occurrences, row_number() OVER (PARTITION BY page_id ORDER BY tier, occurrences DESC, sure, check_id, finding_id) AS place, a.why, a.action
FROM n JOIN (VALUES {sql_rows((k, *v) for k, v in rules.ADVICE.items())}) a(check_id, why, action) USING (check_id)""")
def u01_findings_union(spark: S, d: str) -> DataFrame:
    checks = rules.checks(spark)
    e = held(extracted(spark, d))
    static = N.from_signals(structure(e), checks, X.passages(e))
    coverage = N.from_coverage(d13_page_coverage(spark, d), checks, rules.question_texts(spark))
    found = N.advised(N.united(static, N.from_messaging(d12_messaging(spark, d), checks), coverage), rules.advice(spark))
    return found.select("page_id", "check_id", "confidence", "occurrences", F.col("place").cast("long").alias("place"), "why", "action")


CHECK_ROWS = "ck(check_id, module, priority, tier, observation) AS (VALUES " + ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in c) + ")" for c in rules.CHECKS) + ")"


def sql_reports(kind: str) -> str:
    """Reports of pages on their messaging, in Markdown or as HTML."""
    line = {
        "markdown": r"chr(10) || chr(10) || '### ' || place || '. ' || observation || chr(10) || chr(10) || 'Priority: ' || priority || ', confidence: ' || confidence || chr(10) || chr(10) || why || chr(10) || chr(10) || 'To do: ' || action",
        "html": "'<li><p>' || " + "replace(" * 4 + "observation, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p><p>' || " + "replace(" * 4 + "action, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p></li>'",
    }[kind]
    url = "replace(url, '&', '&amp;')"
    whole = {
        "markdown": f"'# ' || url || chr(10) || chr(10) || url || chr(10) || chr(10) || '## Findings (' || coalesce(k, 0) || ')' || coalesce(body, chr(10) || chr(10) || '{NOTHING}') || chr(10)",
        "html": f"""'<!doctype html><meta charset="utf-8"><title>' || {url} || '</title><h1>' || {url} || '</h1><p>' || {url} || '</p>' || coalesce('<ol>' || body || '</ol>', '<p>{NOTHING}</p>') || chr(10)""",
    }[kind]
    return f"""WITH m AS ({SQL["d12_messaging"]}), {CHECK_ROWS}, a(check_id, why, action) AS (VALUES {sql_rows((k, *v) for k, v in rules.ADVICE.items())}),
f AS (SELECT page_id, m.confidence, ck.*, why, action, row_number() OVER (PARTITION BY page_id ORDER BY tier, list_position(['high', 'medium', 'low'], m.confidence), check_id) AS place FROM m JOIN ck USING (check_id) JOIN a USING (check_id)),
b AS (SELECT page_id, count(*) AS k, string_agg({line}, '' ORDER BY place) AS body FROM f GROUP BY page_id)
SELECT page_id, 'page-' || page_id || '.{"md" if kind == "markdown" else "html"}' AS name, md5({whole}) AS digest FROM pages LEFT JOIN b USING (page_id)"""


def reported(spark: S, d: str, kind: str) -> DataFrame:
    found = N.advised(N.united(N.from_messaging(d12_messaging(spark, d), rules.checks(spark))), rules.advice(spark))
    pages = table(spark, d, "pages").select("page_id", "url", F.lit(None).cast("string").alias("title"))
    return page_reports(pages, found, kind).select("page_id", "name", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(sql_reports("markdown"))
def s14_page_reports(spark: S, d: str) -> DataFrame:
    return reported(spark, d, "markdown")


@query(sql_reports("html"))
def s15_html_reports(spark: S, d: str) -> DataFrame:
    return reported(spark, d, "html")


#: The questions of a summary, and the options of those that have some.
SUMMARY = (("purpose_clarity", ("sell", "explain", "not_stated")), ("journey_stage", ("awareness", "decision", "purchase")), ("business_type", ("saas", "agency", "not_stated")), ("q_support", ("answers_it", "mentions_only", "not_addressed")), ("q_free_tier", ("answers_it", "mentions_only", "not_addressed")))


def summary_answers(spark: S, d: str) -> DataFrame:
    """Synthetic answers to a summary's questions about pages; every fifth page isn't asked about the bank's."""
    pages = table(spark, d, "pages").select("page_id", F.lit("page").alias("ref_id"))
    out = said(pages, F.lit("names_the_audience"))
    for q, options in SUMMARY:
        of = F.array(*[F.lit(o) for o in options])
        asked = pages.where("page_id % 5 != 0") if q.startswith("q_") else pages
        out = out.unionByName(said(asked, F.lit(q), lambda a, of=of, n=len(options): F.element_at(of, (a % n + 1).cast("int"))))
    return out


@query(f"""WITH x AS (SELECT page_id, q, {sql_said("page_id || ':page:' || q")} FROM pages, (VALUES ('names_the_audience'), {', '.join(f"('{q}')" for q, _ in SUMMARY)}) v(q)),
c AS (SELECT page_id, q, noul, sure, CASE {' '.join(f"WHEN q = '{q}' THEN {list(o)}[a % {len(o)} + 1]" for q, o in SUMMARY)} END AS choice FROM x WHERE CASE WHEN q = 'names_the_audience' THEN sure >= 0.6 ELSE stated >= 0.5 END AND NOT (starts_with(q, 'q_') AND page_id % 5 = 0)),
t AS ({SQL["a10_topic_terms"]})
SELECT p.page_id, regexp_extract(lower(regexp_extract(url, '://([^/?#]*)', 1)), '([^.]+\\.[^.]+)$', 1) AS site, coalesce(any_value(t.terms), '') AS terms,
  max(choice) FILTER (q = 'purpose_clarity' AND choice != 'not_stated') AS purpose, max(choice) FILTER (q = 'business_type' AND choice != 'not_stated') AS business_type, max(choice) FILTER (q = 'journey_stage') AS stage,
  bool_or(noul >= 0.5) FILTER (q = 'names_the_audience') AS audience_named,
  CASE WHEN p.page_id % 5 != 0 THEN coalesce(string_agg(q, ',' ORDER BY q) FILTER (starts_with(q, 'q_') AND choice != 'not_addressed'), '') END AS raised,
  CASE WHEN p.page_id % 5 != 0 THEN coalesce(string_agg(q, ',' ORDER BY q) FILTER (starts_with(q, 'q_') AND choice = 'answers_it'), '') END AS answered
FROM pages p LEFT JOIN c ON c.page_id = p.page_id LEFT JOIN t ON t.page_id = p.page_id GROUP BY p.page_id, url""")
def d15_page_summaries(spark: S, d: str) -> DataFrame:
    """Summaries by the whole chain, with their answers; counts of findings are tested against reports."""
    from pagewright.operators import audit

    joined = lambda c: F.array_join(c, ",").alias(c)
    rows = audit.page_summaries(table(spark, d, "pages"), summary_answers(spark, d))
    return rows.select("page_id", "site", joined("terms"), "purpose", "business_type", "stage", "audience_named", joined("raised"), joined("answered"))


def digested(states: DataFrame, by: str = "page_id") -> DataFrame:
    return states.select(by, "ref_id", F.md5(F.col("state").cast("binary")).alias("digest"), "tokens")


@query(f"""WITH {PAGES}, o AS (SELECT page_id, string_agg(text, ' ' ORDER BY passage_ord)[:1200] AS opening FROM paras WHERE passage_ord < 3 GROUP BY page_id),
s AS (SELECT a.page_id, to_json({{'url': url, 'title': title, 'meta_description': NULL::VARCHAR, 'headings': ['# ' || h.text], 'opening_text': coalesce(opening, '')}})::VARCHAR AS state FROM arts a JOIN heads h USING (page_id) LEFT JOIN o USING (page_id))
SELECT page_id, 'page' AS ref_id, md5(state) AS digest, ceil(length(state) / 3.5)::BIGINT AS tokens FROM s""")
def d16_page_states(spark: S, d: str) -> DataFrame:
    return digested(ST.page_states(extracted(spark, d)))


@query(f"""WITH RECURSIVE {TURNS}, {TURN_SECTIONS}, o AS (SELECT page_id, section_ord, passage_ord, text, row_number() OVER (PARTITION BY page_id, section_ord ORDER BY passage_ord) AS i, ceil(length(text) / 3.5)::BIGINT AS t FROM raw_turns),
walk AS (SELECT page_id, section_ord, i, t AS tokens, 0 AS chunk FROM o WHERE i = 1 UNION ALL
  SELECT o.page_id, o.section_ord, o.i, CASE WHEN w.tokens + o.t > 60 THEN o.t ELSE w.tokens + o.t END, CASE WHEN w.tokens + o.t > 60 THEN w.chunk + 1 ELSE w.chunk END FROM walk w JOIN o ON o.page_id = w.page_id AND o.section_ord = w.section_ord AND o.i = w.i + 1),
c AS (SELECT o.page_id, o.section_ord, chunk, string_agg(text, chr(10) || chr(10) ORDER BY o.i) AS text FROM o JOIN walk w ON w.page_id = o.page_id AND w.section_ord = o.section_ord AND w.i = o.i GROUP BY ALL),
w AS (SELECT page_id, section_ord, sum(len(string_split_regex(text, '\\s+'))) AS n FROM o GROUP BY page_id, section_ord),
n AS (SELECT page_id, section_ord FROM w WHERE n >= 12 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, section_ord) <= 5),
p AS (SELECT c.*, heading, level, count(*) OVER (PARTITION BY page_id, section_ord) AS parts FROM c JOIN n USING (page_id, section_ord) JOIN turn_sections USING (page_id, section_ord)),
s AS (SELECT page_id, 's' || section_ord || CASE WHEN parts > 1 THEN '#' || chunk ELSE '' END AS ref_id, CASE WHEN parts > 1 THEN to_json({{'page_title': 'Untitled page', 'heading': heading, 'heading_level': level, 'text': text, 'part': (chunk + 1) || ' of ' || parts}})::VARCHAR
  ELSE to_json({{'page_title': 'Untitled page', 'heading': heading, 'heading_level': level, 'text': text}})::VARCHAR END AS state FROM p)
SELECT page_id, ref_id, md5(state) AS digest, ceil(length(state) / 3.5)::BIGINT AS tokens FROM s""")
def d16_w07_split_section_states(spark: S, d: str) -> DataFrame:
    """Turns as sections, with a budget of 60 tokens so that long ones are cut."""
    rows = turns(spark, d)
    docs = rows.select("page_id").distinct().withColumn("title", F.lit(None).cast("string"))
    return digested(ST.section_states(docs, turn_sections(spark, d), rows, budget=60, most=5))


@query(f"""WITH {SUMMARIES}, k AS (SELECT *, {TERMS} AS terms, row_number() OVER (PARTITION BY site ORDER BY ord) AS nth FROM summaries),
s AS (SELECT site, to_json({{'pages': list({{'url': url, 'purpose': purpose, 'business_type': business_type, 'terms': terms, 'audience_named': audience_named, 'has_action': has_action, 'stage': stage}} ORDER BY nth)}})::VARCHAR AS state FROM k WHERE nth <= 25 GROUP BY site)
SELECT site, 'site' AS ref_id, md5(state) AS digest, ceil(length(state) / 3.5)::BIGINT AS tokens FROM s""")
def d16_site_states(spark: S, d: str) -> DataFrame:
    return digested(ST.site_states(summaries(spark, d)), by="site")

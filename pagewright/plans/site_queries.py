"""Queries of decision, roll-up, sink and streaming operators, and of operator classes on the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions import text as T
from pagewright.operators import decide as D
from pagewright.operators import extract as X
from pagewright.operators import findings as N
from pagewright.operators import site as R
from pagewright.sources.held import held

from .page_queries import PRIORITY, STRUCTURE, structure
from .registry import SQL, query
from .views import ANSWERS, HOST, SUMMARIES, TURN_SECTIONS, TURNS, answers, digit, sql_digit, sql_rows, summaries, table, turn_sections, turns

S = SparkSession


@query(f"WITH {ANSWERS} SELECT page_id, ref_id, question_id, round(confidence, 6) AS confidence FROM confident")
def p26_s12_confidence_gate(spark: S, d: str) -> DataFrame:
    return D.confident(answers(spark, d)).select("page_id", "ref_id", "question_id", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {ANSWERS} SELECT CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM confident GROUP BY 1")
def p27_bands(spark: S, d: str) -> DataFrame:
    return D.confident(answers(spark, d)).groupBy(T.banded(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


PROMISES = r"(length(label) >= 4 AND (contains(label, '?') OR len(string_split_regex(label, '\s+')) >= 2 AND NOT (len(string_split_regex(label, '\s+')) <= 3 AND regexp_matches(label, '^[A-Z][a-z]+(\s[A-Z][a-z]+){1,2}$'))))"
FIRED = f"""{ANSWERS}, {TURN_SECTIONS}, fired AS (
  SELECT page_id, ref_id, check_id, label, confidence FROM (SELECT c.*, heading AS label FROM confident c LEFT JOIN turn_sections s ON s.page_id = c.page_id AND s.section_ord::VARCHAR = c.ref_id)
  JOIN (VALUES {', '.join(str((c, q, p, op, v)) for c, s, q, p, op, v in rules.TRIGGERS if s == 'section')}) r(check_id, q, promissory, op, operand) ON question_id = q
  WHERE CASE op WHEN 'noul<' THEN noul < TRY_CAST(operand AS DOUBLE) WHEN 'choice=' THEN choice = operand WHEN 'score>=' THEN score >= TRY_CAST(operand AS DOUBLE) ELSE score < TRY_CAST(operand AS DOUBLE) END AND (NOT promissory OR {PROMISES})
)"""


def fired(spark: S, d: str) -> DataFrame:
    labels = turn_sections(spark, d).select("page_id", F.lit("section").alias("scope"), F.col("section_ord").cast("string").alias("ref_id"), F.col("heading").alias("label"))
    return D.triggered(D.confident(answers(spark, d)), labels, rules.triggers(spark))


@query(f"WITH {FIRED} SELECT page_id, ref_id, check_id FROM fired")
def p28_j04_triggers(spark: S, d: str) -> DataFrame:
    return fired(spark, d).select("page_id", "ref_id", "check_id")


@query(f"""WITH {FIRED}, s(winner, loser) AS (VALUES {', '.join(str(x) for x in rules.SUBSUMES)}) SELECT page_id, check_id || ':' || ref_id AS finding_id, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS confidence,
replace(CASE {' '.join(f"WHEN check_id = '{c[0]}' THEN '{c[4]}'" for c in rules.CHECKS)} END, '{{label}}', coalesce(label, 'Untitled section')) AS observation
FROM fired f WHERE NOT EXISTS (SELECT 1 FROM fired w JOIN s ON w.check_id = winner WHERE w.page_id = f.page_id AND w.ref_id = f.ref_id AND loser = f.check_id)""")
def d10_decision_findings(spark: S, d: str) -> DataFrame:
    found = N.without_subsumed(N.from_triggers(fired(spark, d), rules.checks(spark)), rules.subsumes(spark))
    return found.select("page_id", "finding_id", "confidence", "observation")


@query(f"WITH {ANSWERS}, c AS (SELECT *, ref_id::INT // 2 AS base, ref_id::INT % 2 AS chunk FROM answers) SELECT page_id, base::VARCHAR AS ref_id, question_id, atype FROM c QUALIFY row_number() OVER (PARTITION BY page_id, base, question_id ORDER BY chunk) = 1")
def j05_split_sections(spark: S, d: str) -> DataFrame:
    n = F.col("ref_id").cast("int")
    chunked = answers(spark, d).withColumn("ref_id", F.concat_ws("#", F.floor(n / 2).cast("string"), (n % 2).cast("string")))
    return D.merged_chunks(chunked).select("page_id", "ref_id", "question_id", "atype")


@query(f"WITH {ANSWERS} SELECT page_id, ref_id FROM (SELECT DISTINCT page_id, ref_id FROM answers) a WHERE NOT EXISTS (SELECT 1 FROM confident c WHERE c.page_id = a.page_id AND c.ref_id = a.ref_id AND question_id = 'self_contained' AND noul < 0.5)")
def d17_claim_gate(spark: S, d: str) -> DataFrame:
    a = answers(spark, d).withColumn("question_id", F.when(F.col("question_id") == "self_contained", "is_claim").otherwise(F.col("question_id")))
    return D.claim_gate(a.select("page_id", "ref_id").distinct(), a)


@query(f"""SELECT conv_id AS page_id, 't' || turn AS ref_id, q AS question_id, CASE WHEN k % 3 = 0 THEN 0.9::DOUBLE ELSE 0.0 END AS confidence FROM (SELECT conv_id, turn, conv_id + turn AS k FROM conversations), (VALUES ('a'), ('b')) v(q)""")
def s10_j16_replay(spark: S, d: str) -> DataFrame:
    """Answers are recorded for every third state."""
    c = table(spark, d, "conversations")
    states = c.select(F.col("conv_id").alias("page_id"), F.lit("section").alias("scope"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("ref_id"), F.to_json(F.struct("conv_id", "turn", "text")).alias("state"), F.array(F.lit("b"), F.lit("a")).alias("questions"), (F.col("conv_id") + F.col("turn")).alias("k"))
    recorded = states.where("k % 3 = 0").select(D.fixture_key(F.col("state"), F.col("questions")).alias("key"), D.fixture_digest(F.col("state"), F.col("questions")).alias("digest"), F.explode("questions").alias("question_id"), F.lit("noul").alias("atype"), F.lit(0.95).alias("noul"), F.lit(None).cast("string").alias("choice"), F.lit(None).cast("double").alias("score"), F.lit(2).alias("n_options"), F.lit(0.9).alias("confidence"))
    return D.replayed(states, recorded).select("page_id", "ref_id", "question_id", "confidence")


@query(f"""WITH c AS (SELECT doc_id, toxic = 1 AS expect, {sql_digit('doc_id', 1)} / 15.0::DOUBLE AS noul, least(1.0, abs({sql_digit('doc_id', 1)} / 15.0::DOUBLE - 0.5) * 2) AS sure FROM labels), v AS (SELECT *, CASE WHEN sure >= 0.6 THEN noul >= 0.5 END AS said FROM c)
SELECT 'toxic' AS question_id, count(*) AS n, count(*) FILTER (said IS NOT DISTINCT FROM expect) AS agreed, count(*) FILTER (said AND NOT expect) AS false_positives, count(*) FILTER (said IS DISTINCT FROM expect AND sure >= 0.85) AS overconfident FROM v""")
def a23_agreement(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "labels")
    expected = rows.select(F.col("doc_id").alias("case_id"), F.lit("toxic").alias("question_id"), (F.col("toxic") == 1).alias("expect"))
    said = rows.select(F.col("doc_id").alias("case_id"), F.lit("toxic").alias("question_id"), (digit(F.col("doc_id"), 1) / 15.0).alias("noul"), F.lit(None).cast("double").alias("confidence"))
    return D.agreement(expected, said)


# Site ----------------------------------------------------------------------------------------------------------------

SIGNALS = f"{SUMMARIES}, signals AS (SELECT site, count(*) AS pages, count(*) FILTER (audience_named) AS named, count(*) FILTER (NOT has_action) AS without_action, count(*) FILTER (purpose = 'sell') AS sell, count(*) FILTER (purpose = 'explain') AS explain FROM summaries GROUP BY site)"


@query(f"WITH {SIGNALS} FROM signals")
def a11_site_signals(spark: S, d: str) -> DataFrame:
    return R.site_signals(summaries(spark, d))


@query(f"WITH {SUMMARIES} SELECT site, purpose, count(*) AS n FROM summaries WHERE purpose IS NOT NULL GROUP BY ALL")
def a11_purposes(spark: S, d: str) -> DataFrame:
    return R.purposes(summaries(spark, d))


TERMS = "list_filter(all_terms, lambda x, i: list_position(all_terms, x) = i)[:8]"


@query(f"WITH {SUMMARIES}, t AS (SELECT site, ord, unnest(l) AS term, unnest(range(len(l))) AS pos FROM (SELECT site, ord, {TERMS} AS l FROM summaries)), g AS (SELECT site, term, count(*) AS n, min((ord, pos)) AS first FROM t GROUP BY ALL HAVING count(*) >= 3) SELECT site, term, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, first) AS nth FROM g QUALIFY nth <= 8")
def o06_shared_topics(spark: S, d: str) -> DataFrame:
    return R.shared_topics(summaries(spark, d)).withColumn("nth", F.col("nth").cast("long"))


@query(f"WITH {SIGNALS} SELECT site, 'audience_rarely_named' AS check_id FROM signals WHERE pages >= 3 AND named < pages / 2 UNION ALL SELECT site, 'site_has_no_next_step' FROM signals WHERE pages >= 3 AND without_action > pages / 2 UNION ALL SELECT site, 'site_sells_without_explaining' FROM signals WHERE pages >= 3 AND sell / pages > 0.7 AND explain = 0")
def a15_site_checks(spark: S, d: str) -> DataFrame:
    return R.site_checks(R.site_signals(summaries(spark, d)))


STAGES = f"""{SUMMARIES}, counts AS (SELECT site, pos, v.stage, count(*) FILTER (s.stage = v.stage) AS n FROM summaries s, (VALUES {', '.join(f"({k}, '{s}')" for k, s in enumerate(rules.STAGES))}) v(pos, stage) GROUP BY ALL)"""


@query(f"WITH {STAGES} SELECT site, stage, n FROM counts")
def a12_stage_counts(spark: S, d: str) -> DataFrame:
    return R.stage_counts(summaries(spark, d)).select("site", "stage", "n")


@query(f"WITH {STAGES}, t AS (SELECT site, sum(n) AS staged, max(n) AS top, arg_max(stage, n * 100 - pos) AS fullest FROM counts GROUP BY site) SELECT site, stage, CASE WHEN top * 2 >= staged THEN fullest END AS concentrated_in FROM counts JOIN t USING (site) WHERE n = 0 AND staged >= 4")
def a13_stage_gaps(spark: S, d: str) -> DataFrame:
    return R.stage_gaps(R.stage_counts(summaries(spark, d)))


@query(f"WITH {STAGES}, t AS (SELECT site, sum(n) AS staged, max(n) AS top, arg_max(stage, n * 100 - pos) AS fullest FROM counts GROUP BY site) SELECT site, fullest AS stage FROM t WHERE staged >= 4 AND top > 0.3 * staged")
def a14_stage_concentration(spark: S, d: str) -> DataFrame:
    """With a share of 0.3; no site of the tables reaches the default."""
    return R.stage_concentration(R.stage_counts(summaries(spark, d)), share=0.3)


@query(f"""WITH {SUMMARIES}, p AS (SELECT site, ord, stage, purpose, {TERMS} AS terms FROM summaries), m AS (SELECT a.site, a.ord AS a, b.ord AS b, list_filter(b.terms, lambda x: list_contains(a.terms, x)) AS shared, least(len(a.terms), len(b.terms)) AS n FROM p a JOIN p b ON a.site = b.site AND a.stage = b.stage AND a.purpose = b.purpose AND a.ord < b.ord)
SELECT site, a, b, array_to_string(shared, ',') AS shared, round(len(shared) / n, 6) AS ratio FROM m WHERE len(shared) >= 3 AND len(shared) / n >= 0.6 QUALIFY row_number() OVER (PARTITION BY site ORDER BY len(shared) / n DESC, len(shared) DESC, a, b) <= 5""")
def j12_o03_overlaps(spark: S, d: str) -> DataFrame:
    return R.overlaps(summaries(spark, d)).select("site", "a", "b", F.array_join("shared", ",").alias("shared"), F.round("ratio", 6).alias("ratio"))


BANK = "bank(pos, question_id, area, priority, triggers, types) AS (VALUES " + ", ".join(f"({k}, '{q[0]}', '{q[1]}', '{q[2]}', {list(q[3])}, {list(q[4])}::VARCHAR[])" for k, q in enumerate(rules.QUESTIONS)) + ")"


@query(f"""WITH {BANK}, h AS (SELECT doc_id, lower(text) AS text, CASE WHEN {sql_digit('doc_id', 1)} < 12 THEN ['saas', 'nonprofit', 'publisher'][{sql_digit('doc_id', 1)} % 3 + 1] END AS kind FROM documents), m AS (SELECT doc_id, question_id, pos, priority, len(list_filter(triggers, lambda t: contains(text, t))) AS hits FROM h JOIN bank ON len(types) = 0 OR kind IS NULL OR list_contains(types, kind))
SELECT doc_id AS page_id, question_id, hits FROM m WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, hits DESC, pos) <= 6""")
def j09_j10_o04_raised_questions(spark: S, d: str) -> DataFrame:
    n = digit(F.col("doc_id"), 1)
    kinds = F.element_at(F.array(F.lit("saas"), F.lit("nonprofit"), F.lit("publisher")), (n % 3 + 1).cast("int"))
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lower("text").alias("text"), F.when(n < 12, kinds).alias("business_type"))
    return R.raised_questions(pages, rules.questions(spark)).select("page_id", "question_id", F.col("hits").cast("long").alias("hits"))


@query(f"""WITH {SUMMARIES}, {BANK}, fits AS (SELECT DISTINCT site, question_id FROM summaries JOIN bank ON len(types) = 0 OR list_contains(types, business_type)), e AS (SELECT site, ord, url, coalesce(answered, []) AS answered, unnest(list_distinct(list_concat(coalesce(raised, []), coalesce(answered, [])))) AS question_id FROM summaries),
g AS (SELECT site, question_id, bool_or(list_contains(answered, question_id)) AS said, list(url ORDER BY NOT list_contains(answered, question_id), ord) AS pages FROM e GROUP BY ALL) SELECT site, question_id, CASE WHEN said THEN 'answered' WHEN said IS NOT NULL THEN 'unanswered' ELSE 'absent' END AS status, array_to_string(pages, ' ') AS pages FROM fits LEFT JOIN (SELECT site, question_id, said, pages FROM g) g USING (site, question_id)""".replace("array_to_string(pages, ' ') AS pages FROM fits", "coalesce(array_to_string(pages, ' '), '') AS pages FROM fits"))
def a16_coverage(spark: S, d: str) -> DataFrame:
    return R.coverage(summaries(spark, d), rules.questions(spark)).select("site", "question_id", "status", F.array_join("pages", " ").alias("pages"))


@query(f"WITH {SUMMARIES} SELECT site, purpose AS focus_id, count(*) AS checked, coalesce(string_agg(url, ' ' ORDER BY ord) FILTER (has_action), '') AS pages FROM summaries GROUP BY ALL")
def a17_d20_focus(spark: S, d: str) -> DataFrame:
    out = summaries(spark, d).select("site", F.col("purpose").alias("focus_id"), "url", "ord", F.col("has_action").alias("found"))
    return R.focus_coverage(out).select("site", "focus_id", "checked", F.array_join("pages", " ").alias("pages"))


CHECKS = ("no_structured_formats", "journey_stage_missing", "question_raised_unanswered", "no_h1", "vague_claim")
QS = ("q_what_it_costs", "q_free_tier", "q_support")


def job_findings(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    h = F.regexp_extract("url", "://([^/?#]*)", 1)
    check = F.element_at(F.array(*[F.lit(c) for c in CHECKS]), (digit(F.col("page_id"), 1) % 5 + 1).cast("int"))
    q = F.element_at(F.array(*[F.lit(x) for x in QS]), (digit(F.col("page_id"), 2) % 3 + 1).cast("int"))
    rows = p.select(F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1).alias("site"), check.alias("check_id"), F.col("page_id").cast("string").alias("page"), q.alias("q"))
    own = F.col("check_id") == "question_raised_unanswered"
    return rows.select("site", "check_id", "page", F.concat_ws(":", "check_id", F.when(own, F.col("q")).otherwise(F.col("page"))).alias("finding_id"), F.when(own, "question_coverage").otherwise("ai_readiness").alias("module"))


@query(f"""WITH f AS (SELECT regexp_extract(regexp_extract(url, '://([^/?#]*)', 1), '([^.]+\\.[^.]+)$', 1) AS site, {list(CHECKS)}[{sql_digit('page_id', 1)} % 5 + 1] AS check_id, page_id::VARCHAR AS page, {list(QS)}[{sql_digit('page_id', 2)} % 3 + 1] AS q FROM pages),
j AS (SELECT site, check_id, page, CASE WHEN check_id = 'question_raised_unanswered' THEN check_id || ':' || q ELSE check_id || ':' || page END AS finding_id, CASE WHEN check_id = 'question_raised_unanswered' THEN CASE q WHEN 'q_support' THEN 'support' ELSE 'pricing' END END AS area FROM f),
areas AS (SELECT site, area, count(DISTINCT finding_id) AS n, list(DISTINCT finding_id) AS ids, count(DISTINCT page) AS pages FROM j WHERE area IS NOT NULL GROUP BY ALL HAVING count(DISTINCT finding_id) >= 2), gone AS (SELECT site, unnest(ids) AS id FROM areas),
jobs AS (SELECT site, 'recurring:' || check_id AS job_id, CASE check_id WHEN 'no_structured_formats' THEN 2 ELSE 3 END AS tier, count(DISTINCT page) AS pages, list(DISTINCT finding_id) AS ids FROM j WHERE check_id IN ('no_structured_formats', 'question_raised_unanswered', 'vague_claim') GROUP BY site, check_id HAVING count(DISTINCT page) >= 3
UNION ALL SELECT site, 'site:' || finding_id, 3, count(DISTINCT page), list(DISTINCT finding_id) FROM j WHERE check_id = 'journey_stage_missing' GROUP BY site, finding_id),
kept AS (SELECT site, job_id, tier, pages, len(list_filter(ids, lambda i: NOT list_contains(coalesce(g, []), i))) AS n FROM jobs LEFT JOIN (SELECT site, list(id) AS g FROM gone GROUP BY site) USING (site)), every AS (SELECT * FROM kept WHERE n > 0 UNION ALL SELECT site, 'area:' || area, 3, pages, n FROM areas)
SELECT site, job_id, tier, pages, n AS findings FROM every QUALIFY row_number() OVER (PARTITION BY site ORDER BY tier, pages DESC, job_id) <= 6""")
def d19_a18_a20_opportunities(spark: S, d: str) -> DataFrame:
    jobs = R.opportunities(job_findings(spark, d), rules.questions(spark))
    return jobs.select("site", "job_id", "tier", F.size("pages").cast("long").alias("pages"), F.size("ids").cast("long").alias("findings"))


# Catalogue, sinks, streams -------------------------------------------------------------------------------------------


@query(f"SELECT * FROM (VALUES {', '.join(str(c[:4]) for c in rules.CHECKS)}) v(check_id, module, priority, tier)")
def s16_d22_catalogue(spark: S, d: str) -> DataFrame:
    return rules.checks(spark).drop("observation")


def shared_path(spark: S) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}"
    return f"{base}/{uuid.uuid4().hex}"


@query(f"SELECT page_id, url, {HOST} AS host FROM pages")
def s13_json_sink(spark: S, d: str) -> DataFrame:
    """Pages written as JSON and read again."""
    rows = table(spark, d, "pages").select("page_id", "url", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"))
    path = shared_path(spark)
    N.without_banned_keys(rows, rules.BANNED_KEYS).write.json(path)
    return spark.read.schema(rows.schema).json(path)


@query(f"SELECT regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS site, count(*) AS pages, '# ' || regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) || chr(10) || string_agg('- ' || url, chr(10) ORDER BY page_id) AS report FROM pages GROUP BY 1")
def s14_markdown_report(spark: S, d: str) -> DataFrame:
    from pagewright.sources.sinks import markdown

    h = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    rows = table(spark, d, "pages").select(F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1).alias("site"), F.col("page_id").alias("ord"), F.concat(F.lit("- "), "url").alias("line"))
    return markdown(rows, "site")


@query(f"SELECT regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS site, count(*) AS pages, count(DISTINCT {HOST}) AS hosts FROM pages GROUP BY 1")
def t03_incremental_site(spark: S, d: str) -> DataFrame:
    """The site roll-up over a directory of pages that a stream takes in."""
    from pagewright.streaming.scan import scan

    return scan(spark, f"{d}/pages.parquet", shared_path(spark))


@query(f"""WITH s AS ({STRUCTURE}), n AS (SELECT page_id, count(*) AS n, count(*) FILTER ({PRIORITY} = 'high') AS high FROM s GROUP BY page_id),
once AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)
SELECT regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS site, count(*) AS pages, coalesce(sum(n), 0)::BIGINT AS findings, coalesce(sum(n.high), 0)::BIGINT AS high FROM once LEFT JOIN n USING (page_id) GROUP BY 1""")
def t03_t04_incremental_audit(spark: S, d: str) -> DataFrame:
    """Pages audited as they arrive: first a third of them without their titles, then all as they are, in a second run."""
    from pagewright.streaming.scan import audit_scan

    base = shared_path(spark)
    p = table(spark, d, "pages")

    def structural(pages: DataFrame) -> DataFrame:
        e = held(X.extract(pages))
        counts = N.summary(N.from_signals(structure(e), rules.checks(spark), X.passages(e)))
        return e.select("page_id", "url").join(counts, "page_id", "left").select("page_id", "url", F.coalesce("n", F.lit(0)).alias("findings"), F.coalesce("high", F.lit(0)).alias("high"), F.lit(0).alias("acts"))

    p.where("page_id % 3 = 0").withColumn("html", F.regexp_replace("html", "(?s)<title>.*?</title>", "")).write.mode("append").parquet(f"{base}/arrived")
    audit_scan(spark, f"{base}/arrived", base, structural)
    p.write.mode("append").parquet(f"{base}/arrived")
    return audit_scan(spark, f"{base}/arrived", base, structural).select("site", "pages", "findings", "high")


# Operator classes on the star schema ---------------------------------------------------------------------------------


@query("SELECT c_mktsegment, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def g01_join_aggregate(spark: S, d: str) -> DataFrame:
    c, n, o = (table(spark, d, t) for t in ("customer", "nation", "orders"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL")
def g02_aggregate(spark: S, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def g03_top_k(spark: S, d: str) -> DataFrame:
    own = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("nth", F.row_number().over(own)).where("nth <= 2").select("o_custkey", "o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 5)")
def u05_difference(spark: S, d: str) -> DataFrame:
    few = table(spark, d, "lineitem").where("l_quantity < 5")
    return table(spark, d, "part").join(few, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


def sql_told(check: str, **slots: str) -> str:
    """A check's text as SQL, its slots replaced."""
    out = "'" + next(c[4] for c in rules.CHECKS if c[0] == check).replace("'", "''") + "'"
    for k, v in slots.items():
        out = f"replace({out}, '{{{k}}}', ({v})::VARCHAR)"
    return out


STAGE_ROWS = f"stages(stage, whom, cost) AS (VALUES {sql_rows((k, *v) for k, v in rules.STAGE_TEXTS.items())})"
SITE_COUNTS = ("audience_rarely_named", "site_has_no_next_step", "site_sells_without_explaining")


@query(f"""WITH {STAGE_ROWS}, texts(question_id, question) AS (VALUES {sql_rows(rules.QUESTION_TEXTS.items())}), f AS (
  SELECT c.site, check_id, 'site' AS ident, CASE {' '.join(f"WHEN check_id = '{c}' THEN {sql_told(c, named='named', pages='pages', count='without_action', sell='sell', explain='explain')}" for c in SITE_COUNTS)} END AS observation FROM ({SQL['a15_site_checks']}) c JOIN ({SQL['a11_site_signals']}) s USING (site)
  UNION ALL SELECT site, 'journey_stage_missing', stage, {sql_told('journey_stage_missing', audience='whom', cost='cost')} FROM ({SQL['a13_stage_gaps']}) JOIN stages USING (stage)
  UNION ALL SELECT site, 'journey_concentrated', 'site', {sql_told('journey_concentrated', stage='whom')} FROM ({SQL['a14_stage_concentration']}) JOIN stages USING (stage)
  UNION ALL SELECT site, 'question_unanswered_sitewide', question_id, {sql_told('question_unanswered_sitewide', question='question', pages="len(string_split(pages, ' '))")} FROM ({SQL['a16_coverage']}) JOIN texts USING (question_id) WHERE status = 'unanswered'
  UNION ALL SELECT o.site, 'pages_compete', p.url || '|' || q.url, {sql_told('pages_compete', a='p.url', b='q.url', shared="array_to_string(string_split(shared, ',')[:4], ', ')")} FROM ({SQL['j12_o03_overlaps']}) o JOIN pages p ON p.page_id = o.a JOIN pages q ON q.page_id = o.b
) SELECT site, check_id || ':' || ident AS finding_id, check_id, observation FROM f""")
def d18_site_findings(spark: S, d: str) -> DataFrame:
    """With the share of 0.3 for crowded stages, as a14."""
    found = R.site_findings(summaries(spark, d), rules.checks(spark), rules.questions(spark), rules.question_texts(spark), rules.stage_texts(spark), share=0.3)
    return found.select("site", "finding_id", "check_id", "observation")


@query(f"""WITH {FIRED}, {TURNS}, s(winner, loser) AS (VALUES {', '.join(str(x) for x in rules.SUBSUMES)}), said AS (
  SELECT page_id, section_ord::VARCHAR AS ref_id, passage_ord, CASE WHEN length(text) > 240 THEN rtrim(text[:240]) || '…' ELSE text END AS quote FROM raw_turns
), e AS (SELECT page_id, ref_id, list(quote ORDER BY passage_ord)[:2] AS quotes FROM said WHERE len(string_split_regex(quote, '\\s+')) >= 8 GROUP BY ALL), held AS (SELECT * FROM fired JOIN e USING (page_id, ref_id))
SELECT page_id, check_id || ':' || ref_id AS finding_id, len(quotes) AS n_quotes, quotes[1] AS first_quote FROM held f
WHERE NOT EXISTS (SELECT 1 FROM held w JOIN s ON w.check_id = winner WHERE w.page_id = f.page_id AND w.ref_id = f.ref_id AND loser = f.check_id)
QUALIFY row_number() OVER (PARTITION BY page_id, check_id, quotes[1] ORDER BY check_id || ':' || ref_id) = 1""")
def d10_u02_u03_quoted_decisions(spark: S, d: str) -> DataFrame:
    held = turns(spark, d).withColumn("ref_id", F.col("section_ord").cast("string"))
    found = N.from_decisions(fired(spark, d), rules.checks(spark), rules.subsumes(spark), held)
    return found.select("page_id", "finding_id", F.size("quotes").alias("n_quotes"), F.get("quotes", F.lit(0)).alias("first_quote"))

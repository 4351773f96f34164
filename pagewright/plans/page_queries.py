"""Queries of page, section and window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions import text as T
from pagewright.operators import content as C
from pagewright.operators import extract as X
from pagewright.operators import findings as N
from pagewright.operators import site as R
from pagewright.sources.held import held

from .registry import query
from .text_queries import FAMILIES, LEXICON, PROOF, SENT, TOKENS, W, haystack, sql_evidence, sql_hype, sql_kind, with_slots
from .views import LINES, PAGES, TURN_SECTIONS, TURNS, digit, extracted, lines, sql_digit, table, turn_sections, turns

S = SparkSession


@query(f"WITH {PAGES} SELECT a.page_id, a.url, title, lang, n_passages, h.text AS main_heading, digest FROM arts a JOIN heads h USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS n_passages, md5(string_agg(text, chr(10) ORDER BY passage_ord)) AS digest FROM paras GROUP BY page_id) USING (page_id)")
def d01_extract(spark: S, d: str) -> DataFrame:
    texts = F.array_join(F.transform("passages", lambda p: p["text"]), "\n")
    return extracted(spark, d).select("page_id", "url", "title", "lang", F.size("passages").cast("long").alias("n_passages"), F.get("headings", F.lit(0))["text"].alias("main_heading"), F.md5(texts.cast("binary")).alias("digest"))


@query(f"WITH {PAGES} SELECT page_id, passage_ord, section_ord, kind, text FROM paras")
def d01_passages(spark: S, d: str) -> DataFrame:
    return X.passages(extracted(spark, d)).select("page_id", "passage_ord", "section_ord", "kind", "text")


@query(f"WITH {PAGES} SELECT page_id, ord, level, text, section_ord FROM heads")
def d01_headings(spark: S, d: str) -> DataFrame:
    return X.headings(extracted(spark, d))


@query(f"WITH {PAGES} SELECT page_id, section_ord, text AS heading, level FROM heads")
def d01_sections(spark: S, d: str) -> DataFrame:
    return X.sections(extracted(spark, d))


STRUCTURE = f"""WITH {PAGES} SELECT page_id, check_id, slots FROM (
SELECT page_id, 'no_canonical' AS check_id, '' AS slots FROM arts UNION ALL SELECT page_id, 'no_meta_description', '' FROM arts UNION ALL SELECT page_id, 'no_structured_data', '' FROM arts
UNION ALL SELECT page_id, 'weak_title', 'title=' || coalesce(title, '') FROM arts WHERE length(coalesce(title, '')) < 10
UNION ALL SELECT page_id, 'no_structured_formats', 'count=' || count(*) FROM paras GROUP BY page_id HAVING count(*) >= 6
UNION ALL SELECT page_id, 'passages_too_long', 'count=' || count(*) FILTER (len(string_split_regex(text, '\\s+')) > 120) || ';longest=' || max(len(string_split_regex(text, '\\s+'))) FROM paras GROUP BY page_id HAVING count(*) >= 6 AND count(*) FILTER (len(string_split_regex(text, '\\s+')) > 120) > 0
UNION ALL SELECT page_id, 'js_dependent', '' FROM sizes WHERE text_chars < 500 AND script_chars > 3 * text_chars)"""


def structure(e: DataFrame) -> DataFrame:
    """Signals of extracted pages' structure."""
    docs, heads = X.docs(e), X.headings(e)
    return C.machine_access(docs).unionByName(C.structured_data(docs, heads)).unionByName(C.heading_structure(docs, heads)).unionByName(C.extractability(X.passages(e)))


@query(STRUCTURE)
def d02_d05_structure_signals(spark: S, d: str) -> DataFrame:
    """Every page of the tables has one main heading and neither canonical address nor description nor structured data."""
    return with_slots(structure(held(extracted(spark, d))))


@query(rf"""WITH pg AS (SELECT page_id, {sql_digit('page_id', 1)} AS a, {sql_digit('page_id', 2)} AS b, {sql_digit('page_id', 3)} AS c, {sql_digit('page_id', 4)} AS e FROM pages),
blocks AS (
  SELECT page_id, CASE WHEN c = 7 THEN raw[:length(raw) - 1] ELSE raw END AS raw FROM (
    SELECT page_id, c, repeat('{{"x":[', a) || '{{"@type":["A' || b || '","B",5],"name":"\"@type\":\"no\"","type":"no","@graph":[{{"@type":"G' || e || '"}},{{"@type":{{"@type":"deep"}}}}]}}' || repeat(']}}', a) AS raw FROM pg)
  UNION ALL SELECT page_id, '[]' FROM pg WHERE page_id % 3 = 0),
good AS (SELECT page_id, raw, json_valid(raw) AS ok FROM blocks),
tree AS (SELECT page_id, t.key, t.type, t.value, t.atom, t.parent, t.id, t.path FROM good, json_tree(CASE WHEN ok THEN raw ELSE '[]' END) t),
types AS (
  SELECT page_id, json_extract_string(value, '$') AS t FROM tree WHERE key = '@type' AND type = 'VARCHAR'
  UNION ALL SELECT page_id, json_extract_string(x, '$') FROM (SELECT page_id, unnest(from_json(value, '["JSON"]')) AS x FROM tree WHERE key = '@type' AND type = 'ARRAY') WHERE json_type(x) = 'VARCHAR')
SELECT page_id, count(*) AS blocks, count(*) FILTER (NOT ok) AS malformed, coalesce((SELECT array_to_string(list_sort(list(DISTINCT t)), ',') FROM types WHERE types.page_id = good.page_id), '') AS types FROM good GROUP BY page_id""")
def a05_json_ld_types(spark: S, d: str) -> DataFrame:
    """Blocks made of digits of each page: nested to 32 levels and more, some broken, with types that are none."""
    p = table(spark, d, "pages").select("page_id", *[digit(F.col("page_id"), n).cast("int").alias(c) for n, c in ((1, "a"), (2, "b"), (3, "c"), (4, "e"))])
    inner = F.concat(F.lit('{"@type":["A'), F.col("b").cast("string"), F.lit('","B",5],"name":"\\"@type\\":\\"no\\"","type":"no","@graph":[{"@type":"G'), F.col("e").cast("string"), F.lit('"},{"@type":{"@type":"deep"}}]}'))
    raw = F.concat(F.expr("""repeat('{"x":[', a)"""), inner, F.expr("repeat(']}', a)"))
    cut = F.when(F.col("c") == 7, F.expr("left(raw, length(raw) - 1)")).otherwise(F.col("raw"))
    made = p.withColumn("raw", raw).select("page_id", F.when(F.col("page_id") % 3 == 0, F.array(cut, F.lit("[]"))).otherwise(F.array(cut)).alias("json_ld"))
    return C.json_types(made).select("page_id", "blocks", "malformed", F.array_join("types", ",").alias("types"))


@query(f"WITH {PAGES} SELECT page_id, text_chars < 500 AND script_chars > 3 * text_chars AS js_likely FROM sizes")
def p22_script_dependence(spark: S, d: str) -> DataFrame:
    return X.docs(extracted(spark, d)).select("page_id", "js_likely")


OPENERS, VAGUE, DIGITS = "the|of|de|die|la", "and|on|und|et|y", r"\b\d"


@query(rf"""WITH {LINES}, s AS (SELECT page_id, passage_ord, {W} AS n_words, {SENT} AS ss, text FROM lines)
SELECT page_id, passage_ord, n_words, len(ss) AS sentences, len(list_filter(ss, lambda x: regexp_matches(x, '(?i)^\s*(?:{OPENERS})\b'))) AS openers, len(regexp_extract_all(text, '(?i)\b(?:{VAGUE})\b')) AS vague FROM s WHERE n_words >= 25""")
def a09_language_stats(spark: S, d: str) -> DataFrame:
    return C.language_stats(lines(spark, d), OPENERS, VAGUE, DIGITS).select("page_id", "passage_ord", "n_words", "sentences", "openers", F.size("vague").alias("vague"))


@query(rf"""WITH {LINES}, s AS (SELECT *, {W} AS n_words, {SENT} AS ss FROM lines WHERE lang = 'en'), t AS (
SELECT page_id, passage_ord, len(list_filter(ss, lambda x: regexp_matches(x, '(?i)^\s*(?:{OPENERS})\b'))) AS openers, n_words / len(ss) AS mean, len(ss) AS n, list_transform(regexp_extract_all(text, '(?i)\b(?:{VAGUE})\b'), lambda x: lower(x)) AS vague, len(regexp_extract_all(text, '{DIGITS}')) AS specifics FROM s WHERE n_words >= 25),
g AS (SELECT page_id, count(*) FILTER (n >= 2 AND openers / n >= 0.34) AS n1, count(*) FILTER (specifics < 1 AND len(vague) > 0) AS n2, arg_min(vague, passage_ord) FILTER (specifics < 1 AND len(vague) > 0) AS words, count(*) FILTER (mean >= 30) AS n3, max(mean) FILTER (mean >= 30) AS worst FROM t GROUP BY page_id)
SELECT page_id, 'high_anaphora' AS check_id, 'count=' || n1 AS slots FROM g WHERE n1 > 0 UNION ALL SELECT page_id, 'long_sentences', 'count=' || n3 || ';mean=' || round(worst)::BIGINT FROM g WHERE n3 > 0
UNION ALL SELECT page_id, 'vague_quantifiers', 'count=' || n2 || ';words=' || array_to_string(list_transform(list_filter(words, lambda x, i: list_position(words, x) = i)[:3], lambda x: '“' || x || '”'), ', ') FROM g WHERE n2 > 0""")
def d09_language_signals(spark: S, d: str) -> DataFrame:
    rows = lines(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "lang")
    return with_slots(C.language_signals(docs, rows.drop("lang"), OPENERS, VAGUE, DIGITS))


CLAIMS = rf"""{LINES}, claims AS (
  SELECT *, CASE WHEN len(e0) > 0 THEN 0 WHEN len(coalesce(e1, [])) > 0 OR len(coalesce(e2, [])) > 0 THEN 1 WHEN len(coalesce(e3, [])) > 0 OR len(coalesce(e4, [])) > 0 THEN 2 ELSE -1 END AS distance,
    CASE WHEN len(e0) > 0 THEN NULL WHEN len(coalesce(e1, [])) > 0 THEN o1 WHEN len(coalesce(e2, [])) > 0 THEN o2 WHEN len(coalesce(e3, [])) > 0 THEN o3 WHEN len(coalesce(e4, [])) > 0 THEN o4 END AS support
  FROM (SELECT *, lead(e0, 1) OVER w AS e1, lag(e0, 1) OVER w AS e2, lead(e0, 2) OVER w AS e3, lag(e0, 2) OVER w AS e4, lead(passage_ord, 1) OVER w AS o1, lag(passage_ord, 1) OVER w AS o2, lead(passage_ord, 2) OVER w AS o3, lag(passage_ord, 2) OVER w AS o4
    FROM (SELECT *, {sql_evidence()} AS e0, {sql_kind()} AS claim FROM ({sql_hype(4)})) WINDOW w AS (PARTITION BY page_id ORDER BY passage_ord))
  WHERE claim IS NOT NULL AND len(found) > 0 AND len(string_split_regex(text, '\s+')) >= 8
)"""


@query(f"WITH {CLAIMS} SELECT page_id, passage_ord, claim, distance, support, array_to_string(list_transform(found, lambda x: x.term), ',') AS terms FROM claims")
def j03_w03_claims(spark: S, d: str) -> DataFrame:
    found = C.claims(lines(spark, d), list(LEXICON), FAMILIES, PROOF)
    return found.select("page_id", "passage_ord", "claim", "distance", "support", F.array_join("terms", ",").alias("terms"))


@query(f"""WITH {CLAIMS} SELECT page_id, CASE WHEN distance = -1 THEN 'claim_without_evidence' ELSE 'evidence_too_far' END AS check_id, count(*) AS n FROM claims WHERE distance != 0 GROUP BY ALL""")
def d07_claim_signals(spark: S, d: str) -> DataFrame:
    found = C.claims(lines(spark, d), list(LEXICON), FAMILIES, PROOF)
    return C.claim_signals(found, FAMILIES).groupBy("page_id", "check_id").agg(F.count("*").alias("n"))


TERMS = f"list_distinct(list_filter(list_transform(list_filter({TOKENS.format('heading')}, lambda w: length(w) > 2 AND NOT list_contains({list(rules.BURIAL_STOP)}, w)), lambda w: regexp_replace(w, '(ing|ed|es|s)$', '')), lambda w: length(w) > 2))"


@query(rf"""WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), t AS (SELECT doc_id, heading, {SENT} AS ss, {TERMS} AS terms FROM (SELECT doc_id, l[1] AS heading, trim(regexp_replace(array_to_string(l[2:], ' '), '\s+', ' ', 'g')) AS text FROM docs)),
x AS (SELECT doc_id, terms, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM t WHERE len(terms) >= 2 AND len(ss) >= 3),
h AS (SELECT doc_id, i, len({TOKENS.format('s')}) AS n, len(list_filter(terms, lambda z: list_contains(list_transform({TOKENS.format('s')}, lambda w: regexp_replace(w, '(ing|ed|es|s)$', '')), z))) / len(terms) >= 0.4 AS hit FROM x),
a AS (SELECT doc_id, min(i) AS answer FROM h WHERE hit GROUP BY doc_id), b AS (SELECT doc_id, answer, coalesce(sum(n), 0)::BIGINT AS before FROM h JOIN a USING (doc_id) WHERE i < answer OR answer = 0 AND i < 0 GROUP BY ALL)
SELECT doc_id, coalesce(answer, -1) AS answer, coalesce(before, 0) AS before, coalesce(answer, -1) > 0 AND coalesce(before, 0) >= 25 AS buried FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN (SELECT doc_id, before FROM b) USING (doc_id)""")
def w02_d06_burial(spark: S, d: str) -> DataFrame:
    l = F.split("text", "\n")  # noqa: E741
    s = table(spark, d, "documents").select("doc_id", F.get(l, F.lit(0)).alias("heading"), T.collapse(F.array_join(F.slice(l, 2, 1_000_000), " ")).alias("text"))
    return C.burial(s).select("doc_id", F.col("answer").cast("long").alias("answer"), F.col("before").cast("long").alias("before"), "buried")


@query(f"""WITH {TURN_SECTIONS}, x AS (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY section_ord) AS before FROM turn_sections) SELECT page_id, section_ord, level, before FROM x WHERE before > 0 AND level > before + 1""")
def w01_heading_skips(spark: S, d: str) -> DataFrame:
    rows = turn_sections(spark, d).withColumn("ord", F.col("section_ord"))
    return C.heading_skips(rows).select("page_id", "section_ord", "level", "before")


@query(f"""WITH {TURN_SECTIONS}, x AS (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY section_ord) AS before FROM turn_sections), g AS (SELECT page_id, count(*) FILTER (level = 1) AS mains, count(*) FILTER (before > 0 AND level > before + 1) AS skips FROM x GROUP BY page_id)
SELECT page_id, 'no_h1' AS check_id FROM g WHERE mains = 0 UNION ALL SELECT page_id, 'multiple_h1' FROM g WHERE mains > 1 UNION ALL SELECT page_id, 'skipped_heading_levels' FROM g WHERE skips > 0""")
def a04_d03_heading_structure(spark: S, d: str) -> DataFrame:
    rows = turn_sections(spark, d).select("page_id", F.col("section_ord").alias("ord"), "level", F.col("heading").alias("text"))
    return C.heading_structure(rows.select("page_id").distinct(), rows).select("page_id", "check_id")


@query(f"WITH {TURNS} SELECT page_id, passage_ord, boilerplate FROM turns")
def a06_w10_boilerplate(spark: S, d: str) -> DataFrame:
    return turns(spark, d).select("page_id", "passage_ord", "boilerplate")


SECTION_TEXTS = f"""{TURNS}, {TURN_SECTIONS}, section_texts AS (
  SELECT s.*, coalesce(t.text, '') AS text, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_passages, 0) AS n_passages, coalesce(n_own, 0) AS n_own, coalesce(own_words, 0)::BIGINT AS own_words
  FROM turn_sections s LEFT JOIN (SELECT page_id, section_ord, string_agg(text, ' ' ORDER BY passage_ord) AS text, sum({W}) AS n_words, count(*) AS n_passages, count(*) FILTER (NOT boilerplate) AS n_own, sum(len(string_split_regex(text, '\\s+'))) FILTER (NOT boilerplate) AS own_words FROM turns GROUP BY ALL) t USING (page_id, section_ord)
)"""


def section_texts(spark: S, d: str) -> DataFrame:
    return C.section_texts(turn_sections(spark, d), turns(spark, d))


@query(f"WITH {SECTION_TEXTS} SELECT page_id, section_ord, n_words, n_passages, md5(text) AS digest FROM section_texts")
def a07_section_words(spark: S, d: str) -> DataFrame:
    return section_texts(spark, d).select("page_id", "section_ord", "n_words", "n_passages", F.md5(F.col("text").cast("binary")).alias("digest"))


FIRST, WE = "of|in|de|que", "the|la|die"
ISLANDS = rf"""{SECTION_TEXTS}, shaped AS (
  SELECT *, n_words BETWEEN 1 AND 60 AND NOT contains(heading, '?') AND NOT regexp_matches(heading, '(?i)\b(?:{rules.TOPIC_WORDS})\b') AND regexp_matches(heading, '^\p{{L}}[\p{{L}}\p{{N}}''’._\-]*(\s+\p{{L}}[\p{{L}}\p{{N}}''’._\-]*){{0,3}}$') AS shaped,
    len(regexp_extract_all(text, '(?i)\b(?:{FIRST})\b')) AS mine, len(regexp_extract_all(text, '(?i)\b(?:{WE})\b')) AS ours FROM section_texts
), islands AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY section_ord) - row_number() OVER (PARTITION BY page_id, shaped ORDER BY section_ord) AS island FROM shaped
), reviews AS (
  SELECT page_id, section_ord, shaped AND (bool_or(shaped AND mine >= 1 AND mine >= ours) OVER i OR count(*) OVER i >= 3) AS review, mine, ours FROM islands WINDOW i AS (PARTITION BY page_id, shaped, island)
)"""


@query(f"WITH {ISLANDS} SELECT page_id, section_ord, review FROM reviews")
def w05_review_islands(spark: S, d: str) -> DataFrame:
    return C.review_islands(section_texts(spark, d), FIRST, WE, most=60).select("page_id", "section_ord", "review")


@query(f"WITH {ISLANDS} SELECT page_id, section_ord, mine, ours FROM reviews")
def a08_voice_counts(spark: S, d: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(T.whole_words(p)))
    return section_texts(spark, d).select("page_id", "section_ord", count(FIRST).alias("mine"), count(WE).alias("ours"))


@query(f"WITH {SECTION_TEXTS} SELECT page_id, section_ord FROM section_texts WHERE n_passages > 0 AND (n_own = 0 OR own_words < 12 AND n_own < n_passages)")
def w06_link_cards(spark: S, d: str) -> DataFrame:
    return C.link_cards(section_texts(spark, d))


@query(f"WITH {SECTION_TEXTS} SELECT page_id, passage_ord FROM turns t WHERE NOT boilerplate AND NOT EXISTS (SELECT 1 FROM section_texts s WHERE s.page_id = t.page_id AND s.section_ord = t.section_ord AND n_passages > 0 AND (n_own = 0 OR own_words < 12 AND n_own < n_passages))")
def j01_j02_eligible(spark: S, d: str) -> DataFrame:
    return C.eligible(turns(spark, d), C.link_cards(section_texts(spark, d))).select("page_id", "passage_ord")


@query(f"""WITH {PAGES}, texts AS (SELECT page_id, title AS text FROM arts UNION ALL SELECT page_id, text FROM heads), terms AS (
SELECT page_id, regexp_replace(w, '(ing|ed|es|s)$', '') AS term, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}[\\p{{L}}\\p{{N}}''-]{{2,}}')) AS w FROM texts) GROUP BY ALL)
SELECT page_id, array_to_string(list(term ORDER BY n DESC, term)[:8], ',') AS terms FROM terms WHERE length(term) >= 3 AND NOT list_contains({list(rules.TOPIC_STOP)}, term) GROUP BY page_id""")
def a10_topic_terms(spark: S, d: str) -> DataFrame:
    """Of title and all headings of pages."""
    e = extracted(spark, d)
    return C.topic_terms(X.docs(e), X.headings(e)).select("page_id", F.array_join("terms", ",").alias("terms"))


@query(f"WITH {LINES} SELECT page_id, passage_ord FROM lines WHERE length(text) > 40 AND regexp_matches(text, '(?i)\\b(?:{rules.CLAIM_HINTS}|of)\\b') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY passage_ord) <= 3")
def p29_claim_candidates(spark: S, d: str) -> DataFrame:
    return C.claim_candidates(lines(spark, d), rules.CLAIM_HINTS + "|of", 3).select("page_id", "passage_ord")


@query(f"WITH {LINES} SELECT page_id, passage_ord, 'p' || row_number() OVER (PARTITION BY page_id ORDER BY passage_ord) AS key FROM lines WHERE len(string_split_regex(text, '\\s+')) BETWEEN 8 AND 60 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY passage_ord) <= 8")
def p30_j14_shortlist(spark: S, d: str) -> DataFrame:
    return C.shortlist(lines(spark, d)).select("page_id", "passage_ord", "key")


@query(f"WITH {LINES}, x AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY passage_ord) AS nth, sum(length(text)) OVER (PARTITION BY page_id ORDER BY passage_ord) AS upto FROM lines) SELECT page_id, passage_ord FROM x WHERE nth <= 14 AND upto <= 1800")
def w08_char_budget(spark: S, d: str) -> DataFrame:
    return C.budgeted(lines(spark, d)).select("page_id", "passage_ord")


@query(rf"""WITH RECURSIVE {LINES}, o AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY passage_ord) AS i, ceil(length(text) / 3.5)::BIGINT AS t FROM lines), walk AS (
SELECT page_id, i, t AS tokens, 0 AS chunk FROM o WHERE i = 1 UNION ALL SELECT o.page_id, o.i, CASE WHEN w.tokens + o.t > 200 THEN o.t ELSE w.tokens + o.t END, CASE WHEN w.tokens + o.t > 200 THEN w.chunk + 1 ELSE w.chunk END FROM walk w JOIN o ON o.page_id = w.page_id AND o.i = w.i + 1)
SELECT page_id, chunk, min(i)::INT - 1 AS first, max(i)::INT - 1 AS last, max(tokens) AS tokens FROM walk GROUP BY page_id, chunk""")
def w07_chunks(spark: S, d: str) -> DataFrame:
    return C.chunks(lines(spark, d), 200).select("page_id", "chunk", "first", "last", "tokens")


@query(f"WITH {LINES}, h AS (SELECT page_id, passage_ord, row_number() OVER (PARTITION BY page_id ORDER BY passage_ord) AS i, regexp_matches(lower(text), 'idiot|token|worthless|license') AS hit FROM lines) SELECT page_id, passage_ord FROM h a WHERE EXISTS (SELECT 1 FROM h b WHERE a.page_id = b.page_id AND b.hit AND abs(a.i - b.i) <= 1)")
def j11_w04_neighbourhood(spark: S, d: str) -> DataFrame:
    hit = F.lower("text").rlike("idiot|token|worthless|license").cast("int")
    own = Window.partitionBy("page_id").orderBy("passage_ord").rowsBetween(-1, 1)
    return lines(spark, d).withColumn("near", F.max(hit).over(own)).where("near = 1").select("page_id", "passage_ord")


#: Stand-ins for the bank's questions, whose triggers turns do have.
ASKED = ((0, "q_a", "high", ("license", "token")), (1, "q_b", "medium", ("worthless", "idiot", "stupid")), (2, "q_c", "low", ("that", "with")))
ASKS = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains({{t}}, {chr(39)}{x}{chr(39)})' for x in ts)} THEN '{q}' END" for _, q, _, ts in ASKED) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {TURNS}, {TURN_SECTIONS}, docs AS (SELECT conv_id AS page_id, lower(string_agg(text, ' ' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id),
r AS (SELECT page_id, q, list_sum([{', '.join(f"CASE WHEN q = '{q}' THEN {' + '.join(f'contains(text, {chr(39)}{x}{chr(39)})::INT' for x in ts)} ELSE 0 END" for _, q, _, ts in ASKED)}]) AS hits FROM docs, (VALUES ('q_a'), ('q_b'), ('q_c')) v(q)),
chosen AS (SELECT page_id, list(q) AS qs FROM (SELECT * FROM r WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY q) <= 2) GROUP BY page_id),
p AS (SELECT t.page_id, t.section_ord, passage_ord, text, list_has_any({ASKS.format(t='lower(text)')}, qs) AS hit, list_has_any({ASKS.format(t="lower(coalesce(heading, ''))")}, qs) AND row_number() OVER (PARTITION BY t.page_id, t.section_ord ORDER BY passage_ord) <= 3 AS headed
  FROM raw_turns t JOIN chosen USING (page_id) LEFT JOIN turn_sections s ON s.page_id = t.page_id AND s.section_ord = t.section_ord),
n AS (SELECT *, coalesce(lag(hit) OVER w, false) OR hit OR coalesce(lead(hit) OVER w, false) AS near FROM p WINDOW w AS (PARTITION BY page_id ORDER BY passage_ord)),
k AS (SELECT page_id, passage_ord, row_number() OVER w AS nth, sum(length(text)) OVER w AS upto FROM n WHERE near OR headed WINDOW w AS (PARTITION BY page_id ORDER BY passage_ord))
SELECT page_id, passage_ord, nth FROM k WHERE nth <= 14 AND upto <= 600""")
def j11_j09_coverage_passages(spark: S, d: str) -> DataFrame:
    """The bank is a stand-in; a page is judged on two questions at most and 600 characters."""
    bank = spark.createDataFrame([(k, q, p, list(ts), []) for k, q, p, ts in ASKED], "ord int, question_id string, priority string, triggers array<string>, business_types array<string>")
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("page_id")).agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")).alias("text"))
    raised = R.raised_questions(c.withColumn("business_type", F.lit(None).cast("string")), bank, 2)
    return R.coverage_passages(turns(spark, d), turn_sections(spark, d), raised, bank, chars=600).select("page_id", "passage_ord", F.col("nth").cast("long").alias("nth"))


@query(f"WITH {SECTION_TEXTS} SELECT page_id, section_ord FROM section_texts WHERE n_words >= 12 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n_words DESC, section_ord) <= 3")
def o05_w09_largest_sections(spark: S, d: str) -> DataFrame:
    own = Window.partitionBy("page_id").orderBy(F.desc("n_words"), "section_ord")
    return section_texts(spark, d).where("n_words >= 12").withColumn("nth", F.row_number().over(own)).where("nth <= 3").select("page_id", "section_ord")


# Findings ------------------------------------------------------------------------------------------------------------


def findings(spark: S, d: str) -> DataFrame:
    """Findings of all deterministic checks of the pages, in order."""
    from pagewright.operators import audit

    return audit.findings(table(spark, d, "pages"))


TIERS = "CASE " + " ".join(f"WHEN check_id = '{c[0]}' THEN {c[3]}" for c in rules.CHECKS) + " END"
PRIORITY = "CASE " + " ".join(f"WHEN check_id = '{c[0]}' THEN '{c[2]}'" for c in rules.CHECKS) + " END"


@query(f"""WITH s AS ({STRUCTURE}) SELECT page_id, check_id, {TIERS} AS tier, {PRIORITY} AS priority, row_number() OVER (PARTITION BY page_id ORDER BY {TIERS}, check_id) AS place FROM s""")
def o01_impact_order(spark: S, d: str) -> DataFrame:
    e = held(extracted(spark, d))
    found = N.from_signals(structure(e), rules.checks(spark), X.passages(e))
    return N.in_order(found).select("page_id", "check_id", "tier", "priority", F.col("place").cast("long").alias("place"))


@query(f"WITH s AS ({STRUCTURE}) SELECT page_id, count(*) AS n, count(*) FILTER ({PRIORITY} = 'high') AS high, count(*) FILTER ({PRIORITY} = 'medium') AS medium, count(*) FILTER ({PRIORITY} = 'low') AS low FROM s GROUP BY page_id")
def a01_finding_summary(spark: S, d: str) -> DataFrame:
    e = held(extracted(spark, d))
    return N.summary(N.from_signals(structure(e), rules.checks(spark), X.passages(e)))


@query(f"WITH s AS ({STRUCTURE}) SELECT check_id, count(*) AS n, count(DISTINCT page_id) AS pages FROM s GROUP BY check_id")
def a02_occurrences(spark: S, d: str) -> DataFrame:
    return structure(held(extracted(spark, d))).groupBy("check_id").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


MODULE_OF = f"{[c[1] for c in rules.CHECKS]}[event_id % {len(rules.CHECKS)} + 1]"


@query(f"SELECT page_id, module, n, row_number() OVER (PARTITION BY page_id ORDER BY list_position({list(rules.MODULES)}, module)) AS place FROM (SELECT user_id AS page_id, {MODULE_OF} AS module, count(*) AS n FROM events GROUP BY ALL)")
def a03_module_counts(spark: S, d: str) -> DataFrame:
    """Events as findings of all checks in turn."""
    ids = F.array(*[F.lit(c[0]) for c in rules.CHECKS])
    found = table(spark, d, "events").select(F.col("user_id").alias("page_id"), F.element_at(ids, (F.col("event_id") % len(rules.CHECKS) + 1).cast("int")).alias("check_id"))
    told = found.join(F.broadcast(rules.checks(spark).select("check_id", "module")), "check_id")
    return N.module_counts(told).select("page_id", "module", "n", F.col("place").cast("long").alias("place"))


def synthetic_findings(spark: S, d: str) -> DataFrame:
    """Findings of turns as sections, of checks that subsume each other."""
    checks = ("answer_absent", "heading_not_answered", "needs_context", "answer_buried", "heavily_promotional")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    which = digit(F.col("conv_id") * 100 + F.col("turn") * 10 + F.col("k"), 1) % 5
    return c.select(F.col("conv_id").alias("page_id"), F.concat(F.lit("s"), (F.col("turn") % 2).cast("string")).alias("ref"), F.element_at(F.array(*[F.lit(x) for x in checks]), (which + 1).cast("int")).alias("check_id"), F.concat_ws(":", "turn", "k").alias("finding_id"), F.array((F.col("turn") % 3).cast("string")).alias("quotes"))


SYNTHETIC = f"""synthetic AS (SELECT conv_id AS page_id, 's' || (turn % 2) AS ref, ['answer_absent', 'heading_not_answered', 'needs_context', 'answer_buried', 'heavily_promotional'][{sql_digit('conv_id * 100 + turn * 10 + k', 1)} % 5 + 1] AS check_id, turn || ':' || k AS finding_id, (turn % 3)::VARCHAR AS quote FROM conversations, range(1, 4) r(k))"""


@query(f"WITH {SYNTHETIC}, rules(winner, loser) AS (VALUES {', '.join(str(x) for x in rules.SUBSUMES)}) SELECT page_id, ref, check_id, finding_id FROM synthetic f WHERE NOT EXISTS (SELECT 1 FROM synthetic w JOIN rules ON w.check_id = winner WHERE w.page_id = f.page_id AND w.ref = f.ref AND loser = f.check_id)")
def u02_subsumption(spark: S, d: str) -> DataFrame:
    return N.without_subsumed(synthetic_findings(spark, d), rules.subsumes(spark)).select("page_id", "ref", "check_id", "finding_id")


@query(f"WITH {SYNTHETIC} SELECT page_id, check_id, finding_id FROM synthetic QUALIFY row_number() OVER (PARTITION BY page_id, check_id, quote ORDER BY finding_id) = 1")
def u03_repeated_evidence(spark: S, d: str) -> DataFrame:
    return N.first_of_evidence(synthetic_findings(spark, d)).select("page_id", "check_id", "finding_id")


@query(f"WITH {PAGES} SELECT page_id, md5(lower(concat_ws(' ', coalesce(title, ''), '', h.text, p.text))) AS digest FROM arts JOIN heads h USING (page_id) LEFT JOIN (SELECT page_id, string_agg(text, ' ' ORDER BY passage_ord) AS text FROM paras GROUP BY page_id) p USING (page_id) WHERE false")
def u00_no_empty_pages(spark: S, d: str) -> DataFrame:
    """Invariant, without rows: a page whose haystack is blank."""
    return extracted(spark, d).where(F.trim(haystack()) == "").select("page_id", F.md5(haystack().cast("binary")).alias("digest"))

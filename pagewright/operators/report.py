"""Report parts: suggestions, labels, limits, states as JSON, profiles, messaging and coverage findings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions import text as T

from . import decide as D

# Kinds of improvement, profile dimensions, statuses of error codes.
FIXES = {
    "add_a_number": "Give a figure: how many, how much, how fast, against what.",
    "state_the_limit": "Say what it is not for; a stated limit is believed.",
    "cite_evidence": "Name the proof: a test, a case, a document, a customer.",
    "give_an_example": "Show one real situation in which it is used.",
    "define_the_term": "Explain the term in a sentence where it first stands.",
    "already_specific": "Keep the facts and cut the praise around them.",
}
DIMENSIONS = ("business_type", "what_it_does", "who_its_for", "problem_solved", "differentiator")
STATUS = {"invalid_url": 400, "not_html": 400, "blocked_url": 403, "robots_disallowed": 403, "too_large": 413, "fetch_failed": 502, "decision_backend_unavailable": 503, "decision_invalid_response": 500, "internal": 500}
BACKENDS = ("hosted", "own")
MESSAGING = {"states_the_problem": "no_problem_stated", "names_the_audience": "audience_not_named", "states_differentiation": "no_differentiation"}


@dataclass(frozen=True)
class Config:
    """Limits of an audit; from_strings() reads them from text and fails loudly on what isn't a positive number."""

    max_page_bytes: int = 250_000
    max_redirects: int = 5
    fetch_timeout_ms: int = 10_000
    max_calls: int = 14
    confidence: float = 0.6
    max_tokens: int = 24_000
    max_sections: int = 40
    min_words: int = 12

    @classmethod
    def from_strings(cls, given: dict[str, str]) -> Config:
        out = {}
        for f in fields(cls):
            raw = given.get(f.name, given.get(f.name.upper()))
            if raw is None or raw == "":
                continue
            value = float(raw)  # ValueError for what is no number
            if not 0 < value < float("inf"):
                raise ValueError(f"{f.name} must be positive: {raw}")
            out[f.name] = value if f.name == "confidence" else int(value)
        return cls(**out)


def error_status(code: Column) -> Column:
    return F.coalesce(*[F.when(code == c, s) for c, s in STATUS.items()], F.lit(500))


def caller_key(header: Column) -> Column:
    """A key of 20 to 400 plain characters, else null."""
    t = F.trim(header)
    return F.when(t.rlike(r"^[A-Za-z0-9._\-]{20,400}$"), t)


def caller_model(header: Column) -> Column:
    t = F.trim(header)
    return F.when(t.rlike(r"^[A-Za-z0-9._/\-]{1,80}$"), t)


def caller_backend(header: Column) -> Column:
    t = F.lower(F.trim(header))
    return F.when(t.isin(*BACKENDS), t)


def quoted_list(terms: Column) -> Column:
    """“a”, “b” and “c”."""
    q = F.transform(terms, lambda t: F.concat(F.lit("“"), t, F.lit("”")))
    n = F.size(q)
    return F.when(n <= 1, F.array_join(q, "")).otherwise(F.concat(F.array_join(F.slice(q, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(q, -1)))


def suggestion(terms: Column, fix: Column) -> Column:
    """What to do about praise: the terms that are there, and the fix that was chosen (a figure where none was)."""
    told = F.coalesce(*[F.when(fix == k, v) for k, v in FIXES.items()], F.lit(FIXES["add_a_number"]))
    return F.when(F.size(terms) == 0, told).otherwise(F.concat(F.lit("It leans on "), quoted_list(terms), F.lit(". "), told))


def headline(observation: Column, n: Column) -> Column:
    """A finding's observation, said once of n places. One that begins with a quoted heading is said of n sections."""
    quoted = r"^[“\"].+[”\"]\s+"
    rest = F.regexp_replace(observation, quoted, "")
    for one, many in (("does not", "do not"), ("reads", "read"), ("contains", "contain"), ("holds", "hold")):
        rest = F.regexp_replace(rest, f"^{one}", many)
    several = F.when(observation.rlike(quoted), F.concat(n.cast("string"), F.lit(" sections "), rest))
    return F.when(n == 1, observation).otherwise(F.coalesce(several, F.concat(observation, F.lit(" ("), n.cast("string"), F.lit(" places)"))))


def section_names(findings: DataFrame, sections: DataFrame) -> DataFrame:
    """findings (page_id, section_ord, ...) with section, the name under which a reader looks for it: the section's heading;
    where it has none, or isn't there, its number; without a section the page. sections: page_id, section_ord, heading, each
    once; a finding is one row whatever they are."""
    named = sections.groupBy("page_id", "section_ord").agg(F.min(F.when(F.col("heading") != "", F.col("heading"))).alias("_heading"))
    number = F.concat(F.lit("Section "), F.col("section_ord").cast("string"))
    return findings.join(named, ["page_id", "section_ord"], "left").withColumn("section", F.coalesce("_heading", number, F.lit("This page"))).drop("_heading")


def short_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(~url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))


def priority_label(priority: Column) -> Column:
    return F.when(priority == "high", "Now").when(priority == "medium", "Soon").otherwise("Later")


def fix_prompt(observation: Column, quotes: Column, action: Column) -> Column:
    """A finding handed on: what was found, the words it is about, and what may not change."""
    return F.concat_ws("\n", observation, F.when(F.size(quotes) > 0, F.concat(F.lit("The text:\n"), F.array_join(F.transform(quotes, lambda q: F.concat(F.lit("> "), q)), "\n"))), action, F.lit("Keep every fact as it stands."))


def limits(page: dict[str, Column]) -> Column:
    """What a report doesn't cover, as an ordered array of sentences.

    page has degraded, reason, split, lang, supported, reviews, truncated, kept_bytes, total_bytes, cards, analysed, sections
    and js_likely.
    """
    p = page
    said = F.array(
        F.lit("This is about the one page that was read, not about its site."),
        F.when(p["degraded"], F.concat(F.lit("Questions of meaning were left out: "), F.coalesce(p["reason"], F.lit("unknown reason")), F.lit("."))),
        F.when(p["split"], "Long sections were judged in several parts."),
        F.when(~p["supported"], F.concat(F.lit("Language checks are for English; the page is in “"), F.coalesce(p["lang"], F.lit("")), F.lit("”."))),
        F.when(p["reviews"] > 0, F.concat(p["reviews"].cast("string"), F.lit(" section(s) of reviews were left out."))),
        F.when(p["truncated"], F.concat(F.lit("The first "), F.round(p["kept_bytes"] / 1000).cast("long").cast("string"), F.lit(" of "), F.round(p["total_bytes"] / 1000).cast("long").cast("string"), F.lit(" KB were read."))),
        F.when(p["cards"] > 0, F.concat(p["cards"].cast("string"), F.lit(" block(s) of repeated links were left out."))),
        F.when(p["analysed"] < p["sections"], F.concat(F.lit("Of "), p["sections"].cast("string"), F.lit(" sections the "), p["analysed"].cast("string"), F.lit(" largest were judged."))),
        F.when(p["js_likely"], "Scripts may show visitors more than the page as served."),
    )
    return F.filter(said, lambda s: s.isNotNull())


def section_states(docs: DataFrame, sections: DataFrame, most: int = 40, least: int = 12) -> DataFrame:
    """States of the largest sections: page_id, scope, ref_id, state (JSON), tokens. sections as content.section_texts()."""
    own = Window.partitionBy("page_id").orderBy(F.desc("n_words"), "section_ord")
    kept = sections.where(F.col("n_words") >= least).withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most)
    state = F.to_json(F.struct(F.coalesce("title", F.lit("Untitled page")).alias("page_title"), F.coalesce("heading", F.lit("")).alias("heading"), F.col("level").alias("heading_level"), "text"))
    rows = kept.join(docs.select("page_id", "title"), "page_id", "left").select("page_id", F.lit("section").alias("scope"), F.concat(F.lit("s"), F.col("section_ord").cast("string")).alias("ref_id"), state.alias("state"))
    return rows.withColumn("tokens", T.estimated_tokens(F.col("state")))


def claim_states(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """States of claims whose support stands elsewhere: the claim, what it is about and the supporting text."""
    support = passages.select("page_id", F.col("passage_ord").alias("support"), F.col("text").alias("detail"))
    state = F.to_json(F.struct(F.col("text").alias("claim"), F.col("claim").alias("claim_is_about"), F.col("detail").alias("supporting_detail")))
    return claims.join(support, ["page_id", "support"]).select("page_id", F.lit("passage").alias("scope"), F.col("passage_ord").cast("string").alias("ref_id"), state.alias("state"))


def irrelevant_evidence(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """Claims whose support a confident answer says doesn't bear them out: page_id, passage_ord, claim, confidence."""
    no = D.confident(answers.where("question_id = 'evidence_supports_claim'")).where("noul < 0.5").select("page_id", F.col("ref_id").cast("int").alias("passage_ord"), T.page_band(F.col("confidence")).alias("confidence"))
    return claims.select("page_id", "passage_ord", "claim").join(no, ["page_id", "passage_ord"])


def messaging(answers: DataFrame) -> DataFrame:
    """Messaging checks that confident page answers below 0.5 trigger: page_id, check_id, confidence."""
    said = D.confident(answers.where(F.col("question_id").isin(*MESSAGING))).where("noul < 0.5")
    check = F.coalesce(*[F.when(F.col("question_id") == q, c) for q, c in MESSAGING.items()])
    return said.select("page_id", check.alias("check_id"), T.page_band(F.col("confidence")).alias("confidence"))


def page_coverage(answers: DataFrame) -> DataFrame:
    """From confident answers to bank questions: page_id, question_id, answered (else only raised; others are neither) and the
    band of the answer's confidence."""
    said = D.confident(answers).where(F.col("choice").isin("answers_it", "mentions_only"))
    return said.select("page_id", "question_id", (F.col("choice") == "answers_it").alias("answered"), T.page_band(F.col("confidence")).alias("confidence"))


def summary_fields(answers: DataFrame) -> DataFrame:
    """What confident answers say of each page: page_id, purpose, business_type, stage (null where unsure or not stated),
    audience_named (null where unsure), raised and answered (arrays of bank questions; null where none was asked).

    A question that is answered counts as raised, too; one that isn't addressed, or unsure, as neither."""
    one = answers.where("scope = 'page'")
    sure = D.confident(one)
    chosen = lambda q: F.max(F.when(F.col("question_id") == q, F.when(F.col("choice") != "not_stated", F.col("choice"))))
    said = sure.groupBy("page_id").agg(
        chosen("purpose_clarity").alias("purpose"), chosen("business_type").alias("business_type"), chosen("journey_stage").alias("stage"), F.max(F.when(F.col("question_id") == "names_the_audience", F.col("noul") >= 0.5)).alias("audience_named")
    )
    bank = [*rules.QUESTION_TEXTS]
    asked = one.where(F.col("question_id").isin(*bank))
    covered = page_coverage(asked).groupBy("page_id").agg(F.array_sort(F.collect_set("question_id")).alias("raised"), F.array_sort(F.collect_set(F.when(F.col("answered"), F.col("question_id")))).alias("answered"))
    none = F.array().cast("array<string>")
    coverage = asked.select("page_id").distinct().join(covered, "page_id", "left").select("page_id", F.coalesce("raised", none).alias("raised"), F.coalesce("answered", none).alias("answered"))
    return one.select("page_id").distinct().join(said, "page_id", "left").join(coverage, "page_id", "left")


def profile(pages: DataFrame, answers: DataFrame, shortlist: DataFrame) -> DataFrame:
    """page_id, dimension, value, quote, absent and confidence for all five dimensions of each page.

    The business type is the chosen option; other dimensions quote the passage whose key (p1, p2, ...) was chosen. Unsure
    answers, `not_stated` and keys that there aren't leave the dimension absent.
    """
    asked = pages.select("page_id", F.explode(F.array(*[F.lit(x) for x in DIMENSIONS])).alias("dimension"))
    sure = D.confident(answers).where("choice != 'not_stated'").select("page_id", F.col("question_id").alias("dimension"), "choice", "confidence")
    told = asked.join(sure, ["page_id", "dimension"], "left").join(shortlist.select("page_id", F.col("key").alias("choice"), "text"), ["page_id", "choice"], "left")
    kind = F.col("dimension") == "business_type"
    value, quote = F.when(kind, F.col("choice")), F.when(~kind, F.col("text"))
    absent = value.isNull() & quote.isNull()
    return told.select("page_id", "dimension", value.alias("value"), quote.alias("quote"), absent.alias("absent"), F.when(~absent, T.banded(F.col("confidence"))).alias("confidence"))


def capped(rows: DataFrame, order: str, most: int, by: str | None = None) -> DataFrame:
    """The first rows of a request body by their order: what is over its limit is left out."""
    own = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most).drop("nth")


def parsed_body(body: Column, schema: str) -> Column:
    """A request body by its schema; null fields for what doesn't fit, null for what is no JSON object."""
    return F.from_json(body, schema, {"mode": "PERMISSIVE"})


def page_table(summaries: DataFrame) -> DataFrame:
    """Pages in the order of a report: most high findings, most findings, then by path, address and page_id (so that pages with
    one address have an order, too); with place."""
    path = short_path(F.col("url"))
    return summaries.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("high"), F.desc("findings"), path, "url", "page_id")))


def coverage_order(rows: DataFrame, stretch: int = 4096) -> DataFrame:
    """question_id (a number), status and place of all rows: unanswered ones first, then absent, then others, by id.

    Numbered within stretches of `stretch` ids and over their counts, so that no task has to sort a whole status."""
    rank = F.when(F.col("status") == "unanswered", 0).when(F.col("status") == "absent", 1).otherwise(2)
    rows = rows.select("question_id", "status", rank.alias("rank"), F.floor(F.col("question_id") / stretch).alias("range"))
    within = F.row_number().over(Window.partitionBy("rank", "range").orderBy("question_id"))
    sizes = rows.groupBy("rank", "range").agg(F.count("*").alias("n"))
    ranks = sizes.groupBy("rank").agg(F.sum("n").alias("all"))
    lower = ranks.alias("a").join(ranks.alias("b"), F.col("b.rank") < F.col("a.rank"), "left").groupBy("a.rank").agg(F.coalesce(F.sum("b.all"), F.lit(0)).alias("lower"))
    upto = F.sum("n").over(Window.partitionBy("rank").orderBy("range")) - F.col("n")
    before = sizes.withColumn("upto", upto).join(lower, "rank").select("rank", "range", (F.col("upto") + F.col("lower")).alias("before"))
    return rows.withColumn("within", within).join(before, ["rank", "range"]).select("question_id", "status", (F.col("before") + F.col("within")).alias("place"))

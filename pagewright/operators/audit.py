"""The audit of pages, end to end: HTML to findings and page summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions import text as T
from pagewright.sources.held import held

from . import content as C
from . import decide as D
from . import extract as X
from . import findings as N
from . import report as P


def signals(extracted: DataFrame) -> DataFrame:
    """All deterministic signals of extracted pages. Structure and links are judged on all passages; language, claims and
    burial leave out boilerplate and excluded sections."""
    docs, heads, passages, sections = X.docs(extracted), X.headings(extracted), X.passages(extracted), X.sections(extracted)
    texts = C.section_texts(sections, passages)
    excluded = C.excluded_sections(texts)
    eligible = C.eligible(passages, excluded)
    out = C.machine_access(docs)
    for more in (
        C.structured_data(docs, heads), C.heading_structure(docs, heads), C.extractability(passages), C.language_signals(docs, eligible), C.claim_signals(C.claims(eligible)), C.cta_signals(X.links(extracted)),
        buried(sections, eligible),
    ):
        out = out.unionByName(more)
    return out


def buried(sections: DataFrame, eligible: DataFrame) -> DataFrame:
    texts = C.section_texts(sections, eligible).where("n_passages > 0")
    first = eligible.groupBy("page_id", "section_ord").agg(F.min("passage_ord").alias("first"))
    found = C.burial(texts).where("buried").join(first, ["page_id", "section_ord"])
    return C.signals(found, C.signal("answer_buried_positional", F.lit(True), {"heading": F.col("heading"), "words": F.col("before")}, F.array("first")))


def findings(pages: DataFrame) -> DataFrame:
    """Findings of pages (page_id, url, html), each with its place in its page's order."""
    extracted = held(X.extract(pages))
    return N.in_order(N.from_signals(signals(extracted), rules.checks(pages.sparkSession), X.passages(extracted)))


def report(pages: DataFrame, answers: DataFrame, focuses: DataFrame | None = None) -> DataFrame:
    """All findings of pages (page_id, url, html), in order, with why and action: from signals, from answers (as
    decide.ANSWERS; sections are `s` and their number, passages their number) and from focuses (findings.from_focus()).

    A passage of which an answer surely says that it is no claim isn't judged as one (decide.of_claims()).
    """
    spark = pages.sparkSession
    extracted = held(X.extract(pages))
    checks, passages, sections = rules.checks(spark), X.passages(extracted), X.sections(extracted)
    section = F.concat(F.lit("s"), F.col("section_ord").cast("string"))
    labels = sections.select("page_id", F.lit("section").alias("scope"), section.alias("ref_id"), F.col("heading").alias("label"))
    quotable = passages.select("page_id", "passage_ord", "text", F.explode(F.array(section, F.col("passage_ord").cast("string"), F.lit("page"))).alias("ref_id"))
    sure = D.of_claims(D.confident(D.merged_chunks(answers)))
    streams = [
        N.from_signals(signals(extracted), checks, passages), N.from_decisions(D.triggered(sure, labels, rules.triggers(spark)), checks, rules.subsumes(spark), quotable), N.from_messaging(P.messaging(answers), checks),
        N.from_irrelevant(P.irrelevant_evidence(C.claims(C.eligible(passages, C.excluded_sections(C.section_texts(sections, passages)))), answers), checks, passages),
        N.from_coverage(P.page_coverage(answers.where(F.col("question_id").isin(*rules.QUESTION_TEXTS))), checks, rules.question_texts(spark)),
    ]
    streams += [N.from_focus(focuses, checks)] if focuses is not None else []
    return N.advised(N.united(*streams), rules.advice(spark))


def suggestions(pages: DataFrame, answers: DataFrame, limit: int = 3) -> DataFrame:
    """What to do about passages that are claims: page_id, passage_ord, improvement_type (of the passage's own answer, else of
    its section's) and suggestion, for passages that answers speak of and that aren't surely no claims."""
    extracted = held(X.extract(pages))
    spoken = D.improvements(D.of_claims(D.confident(D.merged_chunks(answers))), X.passages(extracted))
    met = spoken.join(X.passages(extracted).select("page_id", "passage_ord", "text"), ["page_id", "passage_ord"])
    terms = met.withColumn("terms", F.transform(T.hype_terms(F.col("text"), None, limit), lambda x: x["term"]))
    return terms.select("page_id", "passage_ord", "improvement_type", P.suggestion(F.col("terms"), F.coalesce("improvement_type", F.lit(""))).alias("suggestion"))


def page_summaries(pages: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """A row a page, as site operators take it: page_id, ord, site, url, title, terms, has_action (whether a link offers one),
    findings and high (their counts), and, of answers (as decide.ANSWERS), the fields of report.summary_fields(), null without.

    With answers findings are those of report(), else those of signals. A site is a registered domain: the last two labels of
    the host."""
    spark = pages.sparkSession
    extracted = held(X.extract(pages))
    docs = X.docs(extracted)
    acts = C.ctas(X.links(extracted)).groupBy("page_id").agg(F.max((F.coalesce("cta", F.lit("")) == "action").cast("int")).alias("acts"))
    checks = rules.checks(spark)
    found = N.from_signals(signals(extracted), checks, X.passages(extracted)) if answers is None else report(pages, answers)
    counts = N.summary(found).select("page_id", F.col("n").alias("findings"), "high")
    said = P.summary_fields(spark.createDataFrame([], D.ANSWERS) if answers is None else D.merged_chunks(answers))
    joined = docs.select("page_id", "url", "title").join(C.topic_terms(docs, X.headings(extracted)), "page_id", "left").join(acts, "page_id", "left").join(counts, "page_id", "left").join(said, "page_id", "left")
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    return joined.select(
        "page_id", F.col("page_id").alias("ord"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("site"), "url", "title", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), (F.coalesce("acts", F.lit(0)) > 0).alias("has_action"),
        F.coalesce("findings", F.lit(0).cast("long")).alias("findings"), F.coalesce("high", F.lit(0).cast("long")).alias("high"), "purpose", "business_type", "stage", "audience_named", "raised", "answered",
    )

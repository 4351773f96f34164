"""Roll-ups over a site's page summaries, and the ranked plan.

page summary: site, ord, url, purpose, business_type, terms, audience_named (null: unknown), has_action, stage, raised and
answered (arrays of question ids, or null).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions import text as T
from pagewright.functions.match import group_hits

MIN_PAGES, SELL_SHARE, STAGE_SHARE, OVERLAP, SHARED_TERMS, PAIRS, JOBS = 3, 0.7, 0.6, 0.6, 3, 5, 6
MOST_QUESTIONS = 10_000


def site_signals(pages: DataFrame) -> DataFrame:
    """A row a site: pages, named (say whom they are for), without_action, sell, explain."""
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return pages.groupBy("site").agg(F.count("*").alias("pages"), yes(F.col("audience_named")).alias("named"), yes(~F.col("has_action")).alias("without_action"), yes(F.col("purpose") == "sell").alias("sell"), yes(F.col("purpose") == "explain").alias("explain"))


def purposes(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("purpose").isNotNull()).groupBy("site", "purpose").agg(F.count("*").alias("n"))


def shared_topics(pages: DataFrame, least: int = MIN_PAGES, most: int = 8) -> DataFrame:
    """Terms that at least `least` of a site's pages have, the most frequent ones; ties by first page and place."""
    each = pages.select("site", "ord", F.posexplode(F.array_distinct("terms")).alias("at", "term"))
    counted = each.groupBy("site", "term").agg(F.count("*").alias("n"), F.min(F.struct("ord", "at")).alias("first")).where(F.col("n") >= least)
    return counted.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "first"))).where(F.col("nth") <= most).select("site", "term", "n", "nth")


def site_checks(signals: DataFrame) -> DataFrame:
    """Site checks that the counts trigger, on sites of enough pages."""
    s = signals.where(F.col("pages") >= MIN_PAGES)
    made = F.array(
        F.when(F.col("named") < F.col("pages") / 2, "audience_rarely_named"), F.when(F.col("without_action") > F.col("pages") / 2, "site_has_no_next_step"),
        F.when((F.col("sell") / F.col("pages") > SELL_SHARE) & (F.col("explain") == 0), "site_sells_without_explaining"),
    )
    return s.select("site", F.explode(F.filter(made, lambda c: c.isNotNull())).alias("check_id"))


def stage_counts(pages: DataFrame) -> DataFrame:
    """site, at, stage, n for all six stages; none and unknown stages don't count."""
    counts = pages.groupBy("site").agg(*[F.count_if(F.col("stage") == s).alias(s) for s in rules.STAGES])
    return counts.select("site", F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in rules.STAGES])).alias("at", "x")).select("site", "at", "x.stage", "x.n")


def stage_gaps(counts: DataFrame, least: int = 4) -> DataFrame:
    """Empty stages of sites with `least` staged pages; concentrated_in: the fullest stage, the first of equals, if it has at
    least half of them."""
    own = Window.partitionBy("site")
    fullest = F.max(F.struct("n", (-F.col("at")).alias("at"), "stage")).over(own)
    rows = counts.withColumns({"staged": F.sum("n").over(own), "fullest": fullest})
    return rows.where((F.col("n") == 0) & (F.col("staged") >= least)).select("site", "stage", F.when(F.col("fullest.n") * 2 >= F.col("staged"), F.col("fullest.stage")).alias("concentrated_in"))


def stage_concentration(counts: DataFrame, least: int = 4, share: float = STAGE_SHARE) -> DataFrame:
    top = counts.groupBy("site").agg(F.sum("n").alias("staged"), F.max(F.struct("n", (-F.col("at")).alias("at"), "stage")).alias("x"))
    return top.where((F.col("staged") >= least) & (F.col("x.n") > share * F.col("staged"))).select("site", F.col("x.stage").alias("stage"))


def overlaps(pages: DataFrame, most: int = PAIRS) -> DataFrame:
    """Pairs of a site's pages of one stage and purpose that share at least 3 terms and 0.6 of the shorter list, the most alike
    first: site, a, b, shared (in the order of the second page), ratio, nth.

    Pages meet by their rarest terms: a pair that shares enough has a common term among all but the last two of each list, as
    rarest come first, and it is compared at the first term that both have, unless the terms left there can't be enough. Of
    pages with one set of terms only the first ones can be among the `most` best pairs: the others are left out before. A page
    that is there twice counts once.
    """
    own = ["site", "stage", "purpose"]
    rows = pages.select(*own, "ord", "terms", F.size("terms").alias("n"), F.array_sort(F.array_distinct("terms")).alias("set")).where(F.size("set") >= SHARED_TERMS).where("stage IS NOT NULL AND purpose IS NOT NULL")
    same = Window.partitionBy(*own, "set", "n").orderBy("ord")
    rows = rows.distinct().withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= most + 1).drop("_nth")
    each = rows.select(*own, "ord", "terms", "n", F.explode("set").alias("term"))
    rarity = each.groupBy("site", "term").agg(F.count("*").alias("pages"))
    placed = each.join(rarity, ["site", "term"]).groupBy(*own, "ord", "terms", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pages", "term"))), lambda x: x["term"]).alias("rare"))

    def side(name: str) -> DataFrame:
        first = placed.select(*own, F.col("ord").alias(name), F.col("terms").alias(f"t{name}"), F.col("n").alias(f"n{name}"), F.col("rare").alias(f"r{name}"), F.posexplode("rare").alias("at", "term"))
        return first.withColumn(f"left{name}", F.size(f"r{name}") - F.col("at")).where(F.col(f"left{name}") >= SHARED_TERMS).drop("at")

    needed = F.greatest(F.lit(float(SHARED_TERMS)), F.least("na", "nb") * OVERLAP)
    met = side("a").join(side("b"), [*own, "term"]).where((F.col("a") < F.col("b")) & (F.least("lefta", "leftb") >= needed))
    met = met.where(F.get(F.array_intersect("ra", "rb"), F.lit(0)) == F.col("term")).withColumn("shared", F.array_intersect("tb", "ta"))
    met = met.withColumn("ratio", F.size("shared") / F.least("na", "nb")).where((F.size("shared") >= SHARED_TERMS) & (F.col("ratio") >= OVERLAP))
    best = Window.partitionBy("site").orderBy(F.desc("ratio"), F.desc(F.size("shared")), "a", "b")
    return met.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most).select("site", "a", "b", "shared", "ratio", "nth")


def bank_groups(bank: DataFrame) -> tuple[list[str], tuple[tuple[str, ...], ...]]:
    """The questions of a bank by ord, and the triggers of each. A bank is a rule table; one of over MOST_QUESTIONS is refused."""
    rows = bank.select("ord", "question_id", "triggers").limit(MOST_QUESTIONS + 1).collect()
    if len(rows) > MOST_QUESTIONS:
        raise ValueError(f"a bank has at most {MOST_QUESTIONS} questions")
    rows = sorted(rows, key=lambda r: r["ord"])
    return [r["question_id"] for r in rows], tuple(tuple(r["triggers"]) for r in rows)


def raised_questions(haystacks: DataFrame, bank: DataFrame, most: int = 6) -> DataFrame:
    """Questions of the bank that a page's text raises: page_id, question_id, hits, nth, from page_id, text (lower case) and
    business_type (null keeps all questions). Texts are read once for the triggers of all questions; the bank, of a checked
    size, meets what was found by question."""
    ids, groups = bank_groups(bank)
    names = F.array(*[F.lit(i) for i in ids])
    each = haystacks.select("page_id", "business_type", F.inline(group_hits(F.col("text"), groups))).withColumn("question_id", F.get(names, F.col("grp")))
    fits = (F.size("business_types") == 0) | F.col("business_type").isNull() | F.array_contains("business_types", F.col("business_type"))
    met = each.join(F.broadcast(bank.select("question_id", "priority", "ord", "business_types")), "question_id").where(fits)
    place = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    own = Window.partitionBy("page_id").orderBy(place, F.desc("hits"), "ord")
    return met.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most).select("page_id", "question_id", "hits", "nth")


def coverage_passages(passages: DataFrame, sections: DataFrame, raised: DataFrame, bank: DataFrame, most: int = 14, chars: int = 1800, under: int = 3) -> DataFrame:
    """The passages from which a page's raised questions are judged: page_id, passage_ord, nth.

    Those that have a trigger of a question that the page raises (raised_questions()), the passage on either side of each, and
    the first `under` of a section whose heading has one; of them the first `most`, and as many as fit in `chars` characters.
    """
    ids, groups = bank_groups(bank)
    names = F.array(*[F.lit(i) for i in ids])
    asks = lambda c: F.transform(group_hits(F.lower(F.coalesce(c, F.lit(""))), groups), lambda x: F.get(names, x["grp"]))
    chosen = raised.groupBy("page_id").agg(F.collect_set("question_id").alias("chosen"))  # at most one for each of the bank
    headed = sections.select("page_id", "section_ord", asks(F.col("heading")).alias("heads")).where(F.size("heads") > 0)
    rows = passages.select("page_id", "section_ord", "passage_ord", "text", asks(F.col("text")).alias("asks")).join(chosen, "page_id").join(headed, ["page_id", "section_ord"], "left")
    page, own = Window.partitionBy("page_id").orderBy("passage_ord"), Window.partitionBy("page_id", "section_ord").orderBy("passage_ord")
    rows = rows.withColumns({"hit": F.arrays_overlap("asks", "chosen"), "first": (F.row_number().over(own) <= under) & F.coalesce(F.arrays_overlap("heads", "chosen"), F.lit(False))})
    near = F.max("hit").over(page.rowsBetween(-1, 1))
    kept = rows.withColumn("near", near).where(F.col("near") | F.col("first"))
    upto = F.sum(F.length("text")).over(page.rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumns({"nth": F.row_number().over(page), "upto": upto}).where((F.col("nth") <= most) & (F.col("upto") <= chars)).select("page_id", "passage_ord", "nth")


def coverage(pages: DataFrame, bank: DataFrame) -> DataFrame:
    """site, question_id, status (answered, unanswered, absent) and pages (answering ones first) of applicable questions."""
    each = pages.withColumns({"raised": F.coalesce("raised", F.array().cast("array<string>")), "answered": F.coalesce("answered", F.array().cast("array<string>"))})
    fits = (F.size("business_types") == 0) | F.col("business_type").isNull() | F.array_contains("business_types", F.col("business_type"))
    met = each.join(F.broadcast(bank), fits).select("site", "question_id").distinct()
    said = each.select("site", "ord", "url", "answered", F.explode(F.array_union("raised", "answered")).alias("question_id")).withColumn("answers", F.array_contains("answered", F.col("question_id")))
    found = said.groupBy("site", "question_id").agg(F.max("answers").alias("any"), F.transform(F.array_sort(F.collect_list(F.struct((~F.col("answers")).alias("later"), "ord", "url"))), lambda x: x["url"]).alias("pages"))
    status = F.when(F.col("any"), "answered").when(F.col("any").isNotNull(), "unanswered").otherwise("absent")
    return met.join(found, ["site", "question_id"], "left").select("site", "question_id", status.alias("status"), F.coalesce("pages", F.array().cast("array<string>")).alias("pages"))


def focus_coverage(outcomes: DataFrame) -> DataFrame:
    """By stated focus: checked (pages) and pages on which it was found, from site, focus_id, url, ord and found."""
    return outcomes.groupBy("site", "focus_id").agg(F.count("*").alias("checked"), F.transform(F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("ord", "url")))), lambda x: x["url"]).alias("pages"))


def site_findings(pages: DataFrame, checks: DataFrame, bank: DataFrame, texts: DataFrame, stages: DataFrame, focuses: DataFrame | None = None, audiences: DataFrame | None = None, share: float = STAGE_SHARE) -> DataFrame:
    """Findings of sites: site, finding_id, check_id, module, priority, tier, observation.

    From the counts of pages (see above), empty and crowded stages, questions that are raised and answered nowhere, pages that
    compete, focuses (site, focus_id, focus, checked, pages) that no page conveys, and audiences (site, choice: confident
    answers, drifting or none_evident). bank, texts and stages as rules.questions(), question_texts() and stage_texts().
    """
    rows: list[DataFrame] = []

    def add(found: DataFrame, check, ident, **slots) -> None:
        filled = F.create_map(*[x for k, v in slots.items() for x in (F.lit(k), v.cast("string"))]) if slots else F.create_map().cast("map<string,string>")
        rows.append(found.select("site", check.alias("check_id"), ident.alias("ident"), filled.alias("slots")))

    counts, signals, col = stage_counts(pages), site_signals(pages), F.col
    add(site_checks(signals).join(signals, "site"), col("check_id"), F.lit("site"), named=col("named"), pages=col("pages"), count=col("without_action"), sell=col("sell"), explain=col("explain"))
    add(stage_gaps(counts).join(stages, "stage"), F.lit("journey_stage_missing"), col("stage"), audience=col("whom"), cost=col("cost"))
    add(stage_concentration(counts, share=share).join(stages, "stage"), F.lit("journey_concentrated"), F.lit("site"), stage=col("whom"))
    opened = coverage(pages, bank).where("status = 'unanswered'").join(texts, "question_id")
    add(opened, F.lit("question_unanswered_sitewide"), col("question_id"), question=col("question"), pages=F.size("pages"))
    url = lambda c: pages.select("site", col("ord").alias(c), col("url").alias(f"url_{c}"))
    pairs = overlaps(pages).join(url("a"), ["site", "a"]).join(url("b"), ["site", "b"])
    add(pairs, F.lit("pages_compete"), F.concat_ws("|", "url_a", "url_b"), a=col("url_a"), b=col("url_b"), shared=F.array_join(F.slice("shared", 1, 4), ", "))
    if focuses is not None:
        add(focuses.where(F.size("pages") == 0), F.lit("focus_not_communicated_sitewide"), col("focus_id"), focus=col("focus"), checked=col("checked"))
    if audiences is not None:
        said = F.when(col("choice") == "drifting", "audience_drifts").when(col("choice") == "none_evident", "audience_none_evident")
        add(audiences.where(said.isNotNull()), said, F.lit("site"))
    told = reduce(DataFrame.unionByName, rows).join(checks, "check_id")
    return told.select("site", F.concat_ws(":", "check_id", "ident").alias("finding_id"), "check_id", "module", "priority", "tier", T.filled(col("observation"), col("slots")).alias("observation"))


def opportunities(findings: DataFrame, bank: DataFrame, single_page: bool = False, most: int = JOBS) -> DataFrame:
    """The plan: site, job_id, kind, subject (check or area), n (of what made it a job), tier, pages, ids, nth, from site, finding_id, check_id, module and page.

    recurring: a listed check on 3 pages and more (on a single page: 2 findings and more). site: each finding of a site-level
    check. area: two and more unanswered questions of one area become one job; they leave the other jobs, which keep their
    pages, and jobs without findings go.
    """
    n = F.count("*") if single_page else F.count_distinct("page")
    pages, ids = F.array_sort(F.collect_set("page")), F.array_sort(F.collect_set("finding_id"))
    recurring = findings.where(F.col("check_id").isin(*rules.RECURRING)).groupBy("site", "check_id").agg(n.alias("n"), pages.alias("pages"), ids.alias("ids")).where(F.col("n") >= (2 if single_page else 3))
    recurring = recurring.select("site", F.concat(F.lit("recurring:"), "check_id").alias("job_id"), F.lit("recurring").alias("kind"), F.col("check_id").alias("subject"), "n", T.tier(F.col("check_id")).alias("tier"), "pages", "ids")
    whole = findings.where(F.col("check_id").isin(*rules.SITE_LEVEL)).groupBy("site", "finding_id", "check_id").agg(pages.alias("pages"), ids.alias("ids"))
    whole = whole.select("site", F.concat(F.lit("site:"), "finding_id").alias("job_id"), F.lit("site").alias("kind"), F.col("check_id").alias("subject"), F.lit(1).cast("long").alias("n"), T.tier(F.col("check_id")).alias("tier"), "pages", "ids")
    asked = findings.where("module = 'question_coverage'").withColumn("question_id", F.split("finding_id", ":")[1]).join(F.broadcast(bank.select("question_id", "area")), "question_id")
    areas = asked.groupBy("site", "area").agg(F.count_distinct("finding_id").alias("n"), pages.alias("pages"), ids.alias("ids"), F.min(T.tier(F.col("check_id"))).alias("tier")).where("n >= 2")
    folded = areas.groupBy("site").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("gone"))
    kept = recurring.unionByName(whole).join(folded, "site", "left").withColumn("ids", F.when(F.col("gone").isNull(), F.col("ids")).otherwise(F.array_except("ids", "gone"))).where(F.size("ids") > 0).drop("gone")
    jobs = kept.unionByName(areas.select("site", F.concat(F.lit("area:"), "area").alias("job_id"), F.lit("area").alias("kind"), F.col("area").alias("subject"), "n", "tier", "pages", "ids"))
    own = Window.partitionBy("site").orderBy("tier", F.desc(F.size("pages")), "job_id")
    return jobs.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most)


def plan_told(jobs: DataFrame, texts: DataFrame, single_page: bool = False) -> DataFrame:
    """Jobs of a plan (opportunities()) with title and reason, from rules.plan_texts(): n is filled in as it was counted, before
    questions of one area left the job. A job without a text isn't told."""
    reason = T.filled(F.col("on_one" if single_page else "on_pages"), F.create_map(F.lit("n"), F.col("n").cast("string")))
    return jobs.join(texts, ["kind", "subject"]).withColumn("reason", reason).drop("on_one", "on_pages")

"""Bodies of requests, read as VARIANT: an array is taken whole if each of its items has the right fields, else its lane says so.

A table of bodies has body_id and body (text). Bodies that are no JSON object, that repeat a key or are null have no fields.
Types are strict: a number in quotes is a text, 3.0 is a whole number, a null fits only where it may stand. Fields beyond those
listed are passed over. Repeated rows are answered each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.sources.held import held

from . import intake as N
from . import site as R

MOST_PAGES, MOST_OUTCOMES, MOST_FINDINGS = 25, 75, 500
LEAST_FOCUS, MOST_FOCUS, FOCUSES = 8, 200, 3
# The modules that a finding may come from.
MODULES = ("ai_readiness", "evidence_trust", "messaging", "website_understanding", "question_coverage", "buyer_journey", "audience_coverage", "product_portfolio", "content_overlap", "content_opportunity")
NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)$"
ADDRESS = r"^(?i)((https?|ftp|wss?):[/\\]*[^/\\?#\s]|(?!(https?|ftp|wss?):)[a-z][a-z0-9+.-]*:)"


@dataclass(frozen=True)
class Field:
    """A field of an item: its path, what it becomes, its kind (text, texts, whole, flag, url or module), and for texts the
    least and the greatest length. nullable: null may stand there. optional: it may be missing as well, and is then null."""

    path: str
    name: str
    kind: str = "text"
    least: int = 0
    most: int | None = None
    nullable: bool = False
    optional: bool = False

    def at(self, item: Column, kind: str = "variant") -> Column:
        return F.try_variant_get(item, f"$.{self.path}", kind)

    def fits(self, item: Column) -> Column:
        found = F.schema_of_variant(self.at(item))  # null if it's missing
        if self.kind == "texts":
            right = F.forall(self.at(item, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
        elif self.kind == "whole":
            number = self.at(item, "double")
            right = found.rlike(NUMBER) & (number >= 0) & (number == F.floor(number))
        elif self.kind == "flag":
            right = found == "BOOLEAN"
        else:
            text = self.at(item, "string")
            right = (found == "STRING") & (F.length(text) >= self.least)
            if self.most is not None:
                right &= F.length(text) <= self.most
            if self.kind == "url":
                right &= text.rlike(ADDRESS)
            elif self.kind == "module":
                right &= text.isin(*MODULES)
        right = F.coalesce(right, F.lit(False))
        if self.nullable:
            right |= F.coalesce(found == "VOID", F.lit(False))
        return right | found.isNull() if self.optional else right

    def value(self, item: Column) -> Column:
        kind = {"texts": "array<string>", "whole": "long", "flag": "boolean"}.get(self.kind, "string")
        return self.at(item, kind).alias(self.name)


SUMMARY = (
    Field("url", "url"), Field("title", "title", nullable=True), Field("purpose", "purpose", nullable=True), Field("businessType", "business_type", nullable=True), Field("topicTerms", "terms", "texts"),
    Field("audienceNamed", "audience_named", "flag", nullable=True), Field("hasAction", "has_action", "flag"), Field("journeyStage", "stage", nullable=True), Field("findingCounts.count", "findings", "whole"), Field("findingCounts.high", "high", "whole"),
)
#: What a page says of the bank's questions: both lists, or no such object.
COVERAGE = (Field("coverage.raised", "raised", "texts"), Field("coverage.answered", "answered", "texts"))
OUTCOME = (Field("id", "focus_id", least=1, most=20), Field("text", "focus", least=1, most=MOST_FOCUS), Field("pageUrl", "url", "url"), Field("found", "found", "flag"))
FINDING = (Field("id", "finding_id", least=1, most=200), Field("checkId", "check_id", least=1, most=100), Field("module", "module", "module"), Field("pageUrl", "page", "url"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def lane(value: Column, name: str, fields: tuple[Field, ...], most: int, together: tuple[Field, ...] = ()) -> tuple[Column, Column]:
    """The state of an array of a body (ok, absent, too_many or invalid) and its items, null unless it is ok.

    `together` are the fields of an object that may be null or missing as a whole."""
    items = F.try_variant_get(value, f"$.{name}", "array<variant>")
    bare = lambda x: F.coalesce(F.schema_of_variant(F.try_variant_get(x, f"$.{together[0].path.split('.')[0]}", "variant")) == "VOID", F.lit(False)) | F.try_variant_get(x, f"$.{together[0].path.split('.')[0]}", "variant").isNull()

    def right(x: Column) -> Column:
        own = _all([f.fits(x) for f in fields])
        return own & (bare(x) | _all([f.fits(x) for f in together])) if together else own

    found = F.try_variant_get(value, f"$.{name}", "variant")
    state = F.when(found.isNull(), "absent").when(items.isNull(), "invalid").when(F.size(items) > most, "too_many").when(F.forall(items, right), "ok").otherwise("invalid")
    return state, F.transform(items, lambda x: F.struct(*[f.value(x) for f in (*fields, *together)]))


def site_requests(bodies: DataFrame) -> DataFrame:
    """A row a body: body_id, status (200, or 400 if the summaries aren't right), pages, enough (pages to compare), the state of
    each lane, and the arrays summaries, outcomes and findings.

    Only the summaries are needed. The other two are empty where they are missing, too many or not right: a wrong item never
    stops an answer, nor is it counted. Nothing is cut: an array over its limit is refused as a whole.
    """
    rows = bodies.select("body_id", F.try_parse_json("body").alias("value"))
    value = F.col("value")
    lanes = {"summaries": lane(value, "summaries", SUMMARY, MOST_PAGES, COVERAGE), "outcomes": lane(value, "focus", OUTCOME, MOST_OUTCOMES), "findings": lane(value, "findings", FINDING, MOST_FINDINGS)}
    judged = rows.select("body_id", *[state.alias(f"{n}_state") for n, (state, _) in lanes.items()], *[items.alias(f"_{n}") for n, (_, items) in lanes.items()])
    kept = [F.when(F.col(f"{n}_state") == "ok", F.col(f"_{n}")).otherwise(F.slice(F.coalesce(F.col(f"_{n}"), F.array()), 1, 0)).alias(n) for n in lanes]
    out = judged.select("body_id", F.when(F.col("summaries_state") == "ok", 200).otherwise(400).alias("status"), *[f"{n}_state" for n in lanes], *kept)
    return out.withColumns({"pages": F.size("summaries"), "enough": F.size("summaries") >= R.MIN_PAGES})


def summaries(requests: DataFrame) -> DataFrame:
    """Page summaries of bodies with enough of them, as the roll-ups take them, the body being the site."""
    return requests.where("enough").select(F.col("body_id").alias("site"), F.posexplode("summaries").alias("ord", "x")).select("site", "ord", "x.*")


def outcomes(requests: DataFrame) -> DataFrame:
    """What pages say of stated focuses: site, ord, focus_id, focus, url, found."""
    return requests.where("enough").select(F.col("body_id").alias("site"), F.posexplode("outcomes").alias("ord", "x")).select("site", "ord", "x.*")


def groupable(requests: DataFrame) -> DataFrame:
    """Findings of pages that a plan is made of: site, finding_id, check_id, module, page."""
    return requests.where("enough").select(F.col("body_id").alias("site"), F.explode("findings").alias("x")).select("site", "x.*")


def focuses(requests: DataFrame) -> DataFrame:
    """Focuses with what all pages say of them, as site_findings() takes them; the wording is that of the first outcome."""
    rows = outcomes(requests)
    said = rows.groupBy("site", "focus_id").agg(F.min_by("focus", "ord").alias("focus"))
    return R.focus_coverage(rows).join(said, ["site", "focus_id"])


def site_answers(requests: DataFrame, checks: DataFrame, bank: DataFrame, texts: DataFrame, stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The findings of each body's site, and the plan that they and the findings of its pages make. Requests are held, as each
    kind of finding reads them: bodies are parsed once."""
    requests = held(requests)
    found = R.site_findings(summaries(requests), checks, bank, texts, stages, focuses(requests))
    whole = found.select("site", "finding_id", "check_id", "module", F.lit(None).cast("string").alias("page"))
    return found, R.opportunities(groupable(requests).unionByName(whole), bank)


def too_few(requests: DataFrame) -> DataFrame:
    """body_id and what is said instead of findings where a body has too few pages."""
    said = F.concat(F.lit(f"Pages are compared from {R.MIN_PAGES} on; this site has "), F.col("pages").cast("string"), F.lit("."))
    return requests.where("status = 200 AND NOT enough").select("body_id", said.alias("limit"))


def page_requests(bodies: DataFrame, most: int = FOCUSES) -> DataFrame:
    """A row a body: body_id, url (normalised; null if refused), error_code (invalid_url or blocked_url), refused (why), focuses
    and part_of_scan (only true itself is).

    Focuses: the texts of the array, without white space around them, of LEAST_FOCUS to MOST_FOCUS characters, each once, the
    first `most`; what isn't a text is passed over.
    """
    value = F.try_parse_json("body")
    kind = lambda n: F.schema_of_variant(F.try_variant_get(value, f"$.{n}", "variant"))
    url = F.when(kind("url") == "STRING", F.try_variant_get(value, "$.url", "string"))
    texts = F.filter(F.coalesce(F.try_variant_get(value, "$.focus", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING")
    texts = F.transform(texts, lambda x: F.regexp_replace(F.variant_get(x, "$", "string"), r"^\s+|\s+$", ""))
    stated = F.slice(F.array_distinct(F.filter(texts, lambda t: F.length(t).between(LEAST_FOCUS, MOST_FOCUS))), 1, most)
    part = F.coalesce((kind("partOfScan") == "BOOLEAN") & F.try_variant_get(value, "$.partOfScan", "boolean"), F.lit(False))
    rows = bodies.select("body_id", url.alias("given"), stated.alias("focuses"), part.alias("part_of_scan"))
    rows = rows.withColumn("refused", N.refusal(F.col("given")))
    code = F.when(F.col("refused").isin("empty", "scheme"), "invalid_url").when(F.col("refused").isNotNull(), "blocked_url")
    return rows.select("body_id", N.normalized(F.col("given")).alias("url"), code.alias("error_code"), "refused", "focuses", "part_of_scan")


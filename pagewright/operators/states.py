"""States: the JSON about which questions are asked, each as small as its questions allow.

page_id (site for sites), scope, ref_id, state (JSON; null fields stay) and tokens (estimated).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

from . import content as C

#: Headings of a page's state and of a coverage state; passages and characters of an opening; tokens of a section's state;
#: pages of a site's inventory.
HEADINGS, ASKED_HEADINGS, OPENING, OPENING_CHARS, SECTION_TOKENS, SITE_PAGES = 40, 25, 3, 1200, 24_000, 25


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _states(rows: DataFrame, scope: str, ref: Column, state: Column, by: str = "page_id") -> DataFrame:
    return rows.select(by, F.lit(scope).alias("scope"), ref.alias("ref_id"), state.alias("state")).withColumn("tokens", T.estimated_tokens(F.col("state")))


def page_states(extracted: DataFrame, headings: int = HEADINGS, opening: int = OPENING, chars: int = OPENING_CHARS) -> DataFrame:
    """A state a page, from extracted pages: address, title, description, headings with their levels, and the beginning of the
    first section that has passages. What makes a page's identity, never its body."""
    heads = F.transform(F.slice("headings", 1, headings), lambda h: F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["text"]))
    first = F.filter("passages", lambda p: p["section_ord"] == F.get("passages", F.lit(0))["section_ord"])
    begins = F.left(F.array_join(F.transform(F.slice(first, 1, opening), lambda p: p["text"]), " "), F.lit(chars))
    state = _json(F.col("url"), F.col("title"), F.col("meta_description"), heads.alias("headings"), begins.alias("opening_text"))
    return _states(extracted, "page", F.lit("page"), state)


def section_states(docs: DataFrame, sections: DataFrame, passages: DataFrame, excluded: DataFrame | None = None, budget: int = SECTION_TOKENS, most: int = 40, least: int = 12) -> DataFrame:
    """States of each page's `most` largest sections of `least` words and more: the page's title, heading, level and text.

    A section over `budget` tokens is cut between passages (content.chunks()) into several states, ref_id `s3#0`, `s3#1` and so
    on, which say which part they are; a longer passage is one by itself. excluded (page_id, section_ord) are left out. Of
    equally large sections the earlier is taken."""
    if excluded is not None:
        passages = passages.join(excluded, ["page_id", "section_ord"], "left_anti")
    held = passages.groupBy("page_id", "section_ord").agg(F.array_sort(F.collect_list(F.struct("passage_ord", "text"))).alias("ps"), F.sum(F.size(F.split("text", r"\s+"))).alias("n_words"))
    own = Window.partitionBy("page_id").orderBy(F.desc("n_words"), "section_ord")
    large = held.where(F.col("n_words") >= least).withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most)
    cut = C.chunks(passages, budget).withColumn("parts", F.count("*").over(Window.partitionBy("page_id", "section_ord")))
    rows = large.join(cut, ["page_id", "section_ord"]).join(sections.select("page_id", "section_ord", "heading", F.col("level").cast("int").alias("heading_level")), ["page_id", "section_ord"]).join(docs.select("page_id", "title"), "page_id", "left")
    text = F.array_join(F.transform(F.slice("ps", F.col("first") + 1, F.col("last") - F.col("first") + 1), lambda p: p["text"]), "\n\n")
    fields = [F.coalesce("title", F.lit("Untitled page")).alias("page_title"), F.col("heading"), F.col("heading_level"), text.alias("text")]
    part = F.concat((F.col("chunk") + 1).cast("string"), F.lit(" of "), F.col("parts").cast("string"))
    ref = F.concat(F.lit("s"), F.col("section_ord").cast("string"), F.when(F.col("parts") > 1, F.concat(F.lit("#"), F.col("chunk").cast("string"))).otherwise(""))
    return _states(rows, "section", ref, F.when(F.col("parts") > 1, _json(*fields, part.alias("part"))).otherwise(_json(*fields)))


def passage_states(candidates: DataFrame, sections: DataFrame) -> DataFrame:
    """States of passages that may be claims: the text and the heading above it."""
    rows = candidates.select("page_id", "section_ord", "passage_ord", "text").join(sections.select("page_id", "section_ord", "heading"), ["page_id", "section_ord"], "left")
    return _states(rows, "passage", F.col("passage_ord").cast("string"), _json(F.col("heading"), F.col("text")))


def coverage_states(docs: DataFrame, headings: DataFrame, passages: DataFrame, kept: DataFrame, most: int = ASKED_HEADINGS) -> DataFrame:
    """States for the questions that pages raise: address, title, the first headings, and the text of kept passages (of
    site.coverage_passages()). Pages without any have none."""
    texts = kept.join(passages.select("page_id", "passage_ord", "text"), ["page_id", "passage_ord"]).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("passage_ord", "text"))), lambda p: p["text"]).alias("relevant_text"))
    first = headings.where(F.col("ord") < most).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda h: h["text"]).alias("headings"))
    rows = texts.join(docs.select("page_id", "canonical", "title"), "page_id").join(first, "page_id", "left")
    state = _json(F.coalesce("canonical", F.lit("")).alias("url"), F.col("title"), F.coalesce("headings", F.array().cast("array<string>")).alias("headings"), F.col("relevant_text"))
    return _states(rows, "page", F.lit("coverage"), state)


def site_states(summaries: DataFrame, most: int = SITE_PAGES) -> DataFrame:
    """A state a site: the inventory of its first `most` pages (as audit.page_summaries()), values and short terms only."""
    own = Window.partitionBy("site").orderBy("ord")
    rows = summaries.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most)
    page = F.struct("nth", F.struct("url", "purpose", "business_type", "terms", "audience_named", "has_action", "stage").alias("page"))
    grouped = rows.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(page)), lambda x: x["page"]).alias("pages"))
    return _states(grouped, "site", F.lit("site"), _json(F.col("pages")), by="site")

"""Checks of a page's structure, language, claims and links, as DataFrame operators over the extracted tables.

Tables are as in operators.extract; every function keeps to the columns it names. A signal is a row of page_id, check_id,
slots (map of strings) and evidence (passage ordinals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions import text as T

Slots = dict[str, Column]


def signal(check: str, fires: Column, slots: Slots | None = None, evidence: Column | None = None) -> Column:
    """One signal as a struct, null where the check doesn't fire."""
    pairs = [x for k, v in (slots or {}).items() for x in (F.lit(k), v.cast("string"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    shown = F.array().cast("array<int>") if evidence is None else F.transform(evidence, lambda x: x.cast("int"))
    return F.when(fires, F.struct(F.lit(check).alias("check_id"), made.alias("slots"), shown.alias("evidence")))


def signals(df: DataFrame, *made: Column) -> DataFrame:
    return df.select("page_id", F.inline(F.filter(F.array(*made), lambda s: s.isNotNull())))


def machine_access(docs: DataFrame) -> DataFrame:
    """Robots metadata, canonical address, title, description and dependence on scripts."""
    robots, canonical, title = F.lower(F.coalesce("meta_robots", F.lit(""))), F.trim(F.coalesce("canonical", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    absolute = F.when(canonical.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), canonical).when(canonical.startswith("//"), F.concat(F.lit("https:"), canonical))
    host = lambda u: F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    invalid = absolute.isNotNull() & (host(absolute) == "")
    return signals(
        docs,
        signal("meta_noindex", robots.rlike(T.whole_words("noindex")), {"value": F.col("meta_robots")}),
        signal("meta_noai", robots.rlike(T.whole_words("noai|noimageai")), {"value": F.col("meta_robots")}),
        signal("no_canonical", canonical == ""),
        signal("canonical_offsite", absolute.isNotNull() & ~invalid & (host(absolute) != host(F.col("url"))), {"canonical": F.left(canonical, F.lit(90))}),
        signal("canonical_invalid", F.coalesce(invalid, F.lit(False)), {"canonical": canonical}),
        signal("weak_title", F.length(title) < 10, {"title": title}),
        signal("no_meta_description", F.trim(F.coalesce("meta_description", F.lit(""))) == ""),
        signal("js_dependent", F.col("js_likely")),
    )


#: Levels of structured data that are searched for types. A page of any other depth must not hold up all pages: each level
#: is a pass over the nodes that have one.
JSON_LEVELS = 64

NODES = """
WITH RECURSIVE nodes(page_id, name, value, level) AS (
  SELECT page_id, CAST(NULL AS STRING), value, 0 FROM {parsed}
  UNION ALL
  SELECT n.page_id, c.key, c.value, n.level + 1 FROM nodes n, LATERAL variant_explode(n.value) c WHERE n.level < {levels}
) SELECT page_id, name, value FROM nodes LIMIT ALL
"""


def json_nodes(blocks: DataFrame, levels: int = JSON_LEVELS) -> DataFrame:
    """page_id, name and value of every node of the parsed blocks (page_id, value) down to `levels` below the top: name is an
    object's key, null for a whole block or an array's element. Objects and arrays are opened level by level."""
    return blocks.sparkSession.sql(NODES, parsed=blocks.select("page_id", "value"), levels=levels)


def json_types(docs: DataFrame) -> DataFrame:
    """page_id, blocks, malformed and types of the structured data blocks: all strings, alone or in an array, that are the
    @type of an object at any depth. What merely looks like a type, within a string or under another key, is none."""
    blocks = docs.select("page_id", F.explode_outer("json_ld").alias("raw")).withColumn("value", F.try_parse_json("raw"))
    named = json_nodes(blocks.where("value IS NOT NULL")).where("name = '@type'")
    one = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    found = named.select("page_id", F.coalesce(F.array(one(F.col("value"))), F.array()).alias("x"), F.try_variant_get("value", "$", "array<variant>").alias("several"))
    found = found.select("page_id", F.explode(F.filter(F.concat("x", F.coalesce(F.transform("several", one), F.array().cast("array<string>"))), lambda t: t.isNotNull())).alias("type"))
    types = found.groupBy("page_id").agg(F.array_sort(F.collect_set("type")).alias("types"))
    counted = blocks.groupBy("page_id").agg(F.count("raw").alias("blocks"), F.count_if(F.col("raw").isNotNull() & F.col("value").isNull()).alias("malformed"))
    return counted.join(types, "page_id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def structured_data(docs: DataFrame, headings: DataFrame) -> DataFrame:
    asked = headings.groupBy("page_id").agg(F.count_if(T.is_question(F.col("text"))).alias("questions"))
    joined = json_types(docs).join(asked, "page_id", "left").fillna(0, ["questions"])
    answers = F.array(*[F.lit(t) for t in rules.ANSWER_TYPES])
    return signals(
        joined,
        signal("no_structured_data", F.col("blocks") == 0),
        signal("malformed_structured_data", F.col("malformed") > 0, {"count": F.col("malformed")}),
        signal("missing_faq_markup", (F.col("questions") >= 3) & ~F.arrays_overlap("types", answers), {"count": F.col("questions"), "types": F.array_join(answers, ", ")}),
    )


def heading_skips(headings: DataFrame) -> DataFrame:
    """Headings whose level is more than one below that of the heading before; going back up never counts."""
    own = Window.partitionBy("page_id").orderBy("ord")
    return headings.withColumn("before", F.lag("level").over(own)).where((F.col("before") > 0) & (F.col("level") > F.col("before") + 1))


def heading_structure(docs: DataFrame, headings: DataFrame) -> DataFrame:
    own = Window.partitionBy("page_id").orderBy("ord")
    marked = headings.withColumn("before", F.lag("level").over(own))
    skip = (F.col("before") > 0) & (F.col("level") > F.col("before") + 1)
    main = F.col("level") == 1
    counted = marked.groupBy("page_id").agg(F.count_if(main).alias("mains"), F.min_by(F.when(main, F.col("text")), F.when(main, F.col("ord"))).alias("first"), F.count_if(skip).alias("skips"), F.min_by(F.when(skip, F.col("text")), F.when(skip, F.col("ord"))).alias("example"))
    joined = docs.select("page_id").join(counted, "page_id", "left").fillna(0, ["mains", "skips"])
    return signals(
        joined,
        signal("no_h1", F.col("mains") == 0),
        signal("multiple_h1", F.col("mains") > 1, {"count": F.col("mains"), "first": F.left("first", F.lit(60))}),
        signal("skipped_heading_levels", F.col("skips") > 0, {"count": F.col("skips"), "example": F.col("example")}),
    )


def extractability(passages: DataFrame, least: int = 6, longest: int = 120) -> DataFrame:
    n = F.size(F.split("text", r"\s+"))
    long = n > longest
    counted = passages.groupBy("page_id").agg(
        F.count("*").alias("all"), F.count_if(F.col("kind").isin("listitem", "cell", "definition")).alias("shaped"), F.count_if(long).alias("long"), F.max(n).alias("longest"),
        F.slice(F.array_sort(F.collect_list(F.when(long, F.col("passage_ord")))), 1, 2).alias("shown"),
    ).where(F.col("all") >= least)
    return signals(
        counted,
        signal("no_structured_formats", F.col("shaped") == 0, {"count": F.col("all")}),
        signal("passages_too_long", F.col("long") > 0, {"count": F.col("long"), "longest": F.col("longest")}, F.col("shown")),
    )


def language_stats(passages: DataFrame, openers: str = rules.OPENERS, vague: str = rules.VAGUE, specific: str = rules.SPECIFIC, least: int = 25) -> DataFrame:
    """passages of `least` words and more with n_words, sentences, openers, specifics and vague (words of the list)."""
    n, ss = T.words(F.col("text")), T.sentences(F.col("text"))
    opens = F.size(F.filter(ss, lambda s: s.rlike(f"(?i)^\\s*(?:{openers}){T.EDGE}")))
    vague_words = F.regexp_extract_all("text", F.lit(T.whole_words(vague)), F.lit(0))
    return passages.withColumns({"n_words": n, "sentences": F.size(ss), "openers": opens, "specifics": F.regexp_count("text", F.lit(T.bounded(specific))), "vague": F.transform(vague_words, F.lower)}).where(F.col("n_words") >= least)


def language_signals(docs: DataFrame, passages: DataFrame, openers: str = rules.OPENERS, vague: str = rules.VAGUE, specific: str = rules.SPECIFIC, share: float = 0.34, mean: float = 30.0) -> DataFrame:
    """Pronoun openers, vague quantities and long sentences, on pages in a supported language."""
    supported = docs.where(T.language_supported(F.col("lang"))).select("page_id")
    s = language_stats(passages.join(supported, "page_id", "left_semi"), openers, vague, specific)
    leans = (F.col("sentences") >= 2) & (F.col("openers") / F.col("sentences") >= share)
    loose = (F.col("specifics") < 1) & (F.size("vague") > 0)
    length = F.col("n_words") / F.col("sentences")
    dense = (F.col("kind") == "paragraph") & (F.col("sentences") > 0) & (length >= mean)
    first3 = lambda c: F.slice(F.array_sort(F.collect_list(F.when(c, F.col("passage_ord")))), 1, 3)
    counted = s.groupBy("page_id").agg(
        F.count_if(leans).alias("n1"), first3(leans).alias("e1"), F.count_if(loose).alias("n2"), first3(loose).alias("e2"), F.min_by(F.when(loose, F.col("vague")), F.when(loose, F.col("passage_ord"))).alias("words"),
        F.count_if(dense).alias("n3"), first3(dense).alias("e3"), F.max(F.when(dense, length)).alias("worst"),
    )
    said = F.array_join(F.transform(F.slice(F.array_distinct("words"), 1, 3), lambda w: F.concat(F.lit("“"), w, F.lit("”"))), ", ")
    return signals(
        counted,
        signal("high_anaphora", F.col("n1") > 0, {"count": F.col("n1")}, F.col("e1")),
        signal("vague_quantifiers", F.col("n2") > 0, {"count": F.col("n2"), "words": said}, F.col("e2")),
        signal("long_sentences", F.col("n3") > 0, {"count": F.col("n3"), "mean": F.round("worst").cast("long")}, F.col("e3")),
    )


def claims(passages: DataFrame, lexicon: list[tuple[str, str]] | None = None, families=rules.CLAIMS, evidence=rules.EVIDENCE, least: int = 8) -> DataFrame:
    """Passages with a lexicon term and a claim family: kind, terms, evidence, support (the ordinal of the passage that has
    it, null for the claim itself) and distance: 0, else 1 or 2 passages in the section (after before before), -1 for none."""
    own = Window.partitionBy("page_id", "section_ord").orderBy("passage_ord")
    found = T.evidence_kinds(F.col("text"), evidence)
    at = F.struct(F.col("evidence").alias("e"), F.col("passage_ord").alias("at"))
    some = F.when(F.size("evidence") > 0, at)
    near = {"own": some, "n1": F.lead(some, 1).over(own), "p1": F.lag(some, 1).over(own), "n2": F.lead(some, 2).over(own), "p2": F.lag(some, 2).over(own)}
    rows = passages.withColumns({"claim": T.claim_kind(F.col("text"), families), "evidence": found}).withColumns(near)
    rows = rows.where(F.col("claim").isNotNull() & (F.size(F.split("text", r"\s+")) >= least)).withColumn("terms", F.transform(T.hype_terms(F.col("text"), lexicon, 4), lambda x: x["term"])).where(F.size("terms") > 0)
    best = F.coalesce("own", "n1", "p1", "n2", "p2")
    distance = F.when(F.col("own").isNotNull(), 0).when(F.coalesce("n1", "p1").isNotNull(), 1).when(F.coalesce("n2", "p2").isNotNull(), 2).otherwise(-1)
    return rows.select("page_id", "section_ord", "passage_ord", "text", "claim", "terms", F.coalesce(best["e"], F.array().cast("array<string>")).alias("evidence"), F.when(distance > 0, best["at"]).alias("support"), distance.alias("distance"))


def claim_signals(found: DataFrame, families=rules.CLAIMS) -> DataFrame:
    what = T.claim_subject(F.col("claim"), families)
    return signals(
        found,
        signal("claim_without_evidence", F.col("distance") == -1, {"what": what}, F.array("passage_ord")),
        signal("evidence_too_far", F.col("distance") > 0, {"what": what, "distance": F.col("distance"), "evidence": F.col("evidence")[0]}, F.array("passage_ord")),
    )


def ctas(links: DataFrame, vague: str = rules.VAGUE_CTA, action: str = rules.ACTION_CTA, nav: str = rules.NAV_TEXT) -> DataFrame:
    """Links as calls to action: cta is vague, action or neither (null); empty, long and navigation texts are left out, and
    of links with one text and address the first counts."""
    kept = links.withColumn("text", F.trim("text")).where((F.col("text") != "") & (F.length("text") <= 60) & ~F.col("text").rlike("(?i)" + nav))
    own = Window.partitionBy("page_id", F.lower("text"), "href").orderBy("link_ord")
    kept = kept.withColumn("nth", F.row_number().over(own)).where("nth = 1").drop("nth")
    return kept.withColumn("cta", F.when(F.col("text").rlike("(?i)" + vague), "vague").when(F.col("text").rlike(T.whole_words(action)), "action"))


def cta_signals(links: DataFrame, vague: str = rules.VAGUE_CTA, action: str = rules.ACTION_CTA, nav: str = rules.NAV_TEXT) -> DataFrame:
    candidates = links.where((F.trim("text") != "") & ~F.trim("text").rlike("(?i)" + nav)).select("page_id").distinct()
    judged = ctas(links, vague, action, nav)
    first3 = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("cta") == "vague", F.struct("link_ord", "text")))), 1, 3), lambda x: F.concat(F.lit("“"), x["text"], F.lit("”")))
    counted = judged.groupBy("page_id").agg(F.count_if(F.col("cta") == "vague").alias("vague"), F.count_if(F.col("cta") == "action").alias("actions"), F.array_join(first3, ", ").alias("examples"))
    joined = candidates.join(counted, "page_id", "left").fillna(0, ["vague", "actions"])
    return signals(joined, signal("vague_cta", F.col("vague") > 0, {"count": F.col("vague"), "examples": F.col("examples")}), signal("no_clear_action", F.col("actions") == 0))


def heading_terms(heading: Column, stop=rules.BURIAL_STOP) -> Column:
    """Different stems of a heading's words of three letters and more that aren't stop words."""
    kept = F.filter(T.tokens(heading), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    return F.array_distinct(F.filter(F.transform(kept, T.stem), lambda w: F.length(w) > 2))


def burial(sections: DataFrame, stop=rules.BURIAL_STOP, share: float = 0.4, least: int = 25) -> DataFrame:
    """From heading and text of sections: answer (index of the first sentence with at least `share` of the heading's terms,
    -1 for none), before (words before it) and buried.

    Sections with under two terms or three sentences aren't judged (-1). One pass over a section's sentences, in place.
    """
    kept = sections.withColumn("terms", heading_terms(F.col("heading"), stop)).withColumn("ss", T.sentences(F.col("text")))
    stems = F.transform(F.col("ss"), lambda s: F.array_distinct(F.transform(T.tokens(s), T.stem)))
    hit = F.transform(stems, lambda s: F.size(F.array_intersect(s, F.col("terms"))) / F.size("terms") >= share)
    judged = kept.withColumn("hit", F.when((F.size("terms") >= 2) & (F.size("ss") >= 3), F.array_position(hit, True) - 1).otherwise(-1).cast("int"))
    counts = F.transform(F.slice("ss", F.lit(1), F.greatest(F.col("hit"), F.lit(0))), lambda s: F.size(T.tokens(s)))
    before = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return judged.withColumns({"answer": F.col("hit"), "before": before}).withColumn("buried", (F.col("answer") > 0) & (F.col("before") >= least)).drop("terms", "ss", "hit")


def section_texts(sections: DataFrame, passages: DataFrame) -> DataFrame:
    """sections with text (their passages, joined by spaces), n_words and n_passages."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("passage_ord", "text"))), lambda x: x["text"])
    joined = passages.groupBy("page_id", "section_ord").agg(F.array_join(parts, " ").alias("text"), F.count("*").alias("n_passages"), F.sum(T.words(F.col("text"))).alias("n_words"), F.count_if(~F.col("boilerplate")).alias("n_own"), F.sum(F.when(~F.col("boilerplate"), F.size(F.split("text", r"\s+"))).otherwise(0)).alias("own_words"))
    return sections.join(joined, ["page_id", "section_ord"], "left").fillna(0, ["n_passages", "n_words", "n_own", "own_words"]).fillna("", ["text"])


def review_islands(sections: DataFrame, reviewer: str = rules.REVIEWER, company: str = rules.COMPANY, most: int = 150, run: int = 3) -> DataFrame:
    """Sections with island (of consecutive review-shaped sections) and review: the whole island if one of its sections
    speaks in the first person, or if it has `run` sections and more."""
    shaped = F.col("n_words").between(1, most) & T.is_name_like(F.col("heading"))
    mine, ours = F.regexp_count("text", F.lit(T.whole_words(reviewer))), F.regexp_count("text", F.lit(T.whole_words(company)))
    own = Window.partitionBy("page_id").orderBy("section_ord")
    marked = sections.withColumns({"shaped": shaped, "seed": shaped & (mine >= 1) & (mine >= ours), "nth": F.row_number().over(own)})
    marked = marked.withColumn("island", F.col("nth") - F.row_number().over(Window.partitionBy("page_id", "shaped").orderBy("section_ord")))
    island = Window.partitionBy("page_id", "shaped", "island")
    return marked.withColumn("review", F.col("shaped") & (F.max(F.col("seed").cast("int")).over(island).cast("boolean") | (F.count("*").over(island) >= run))).drop("nth")


def link_cards(sections: DataFrame, least: int = 12) -> DataFrame:
    """Sections of boilerplate only, or with so much of it that under `least` words are left: page_id, section_ord."""
    return sections.where((F.col("n_passages") > 0) & ((F.col("n_own") == 0) | ((F.col("own_words") < least) & (F.col("n_own") < F.col("n_passages"))))).select("page_id", "section_ord")


def excluded_sections(sections: DataFrame) -> DataFrame:
    """Sections that text operators leave out: reviews and link cards."""
    return review_islands(sections).where("review").select("page_id", "section_ord").unionByName(link_cards(sections)).distinct()


def eligible(passages: DataFrame, excluded: DataFrame) -> DataFrame:
    return passages.where(~F.col("boilerplate")).join(excluded, ["page_id", "section_ord"], "left_anti")


def topic_terms(docs: DataFrame, headings: DataFrame, stop=rules.TOPIC_STOP, most: int = 8) -> DataFrame:
    """page_id and terms: the most frequent stems of title and headings; ties in the order of their code points."""
    texts = docs.select("page_id", F.col("title").alias("text")).unionByName(headings.select("page_id", "text"))
    raw = texts.select("page_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}[\p{L}\p{N}'-]{2,}"), F.lit(0))).alias("w")).withColumn("term", T.stem(F.col("w")))
    counted = raw.where((F.length("term") >= 3) & ~F.col("term").isin(*stop)).groupBy("page_id", "term").agg(F.count("*").alias("n"))
    top = counted.withColumn("at", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "term"))).where(F.col("at") <= most)
    return top.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("terms"))


def first_passages(passages: DataFrame, condition: Column, most: int) -> DataFrame:
    """The first `most` passages of each page, in its order, for which the condition holds."""
    own = Window.partitionBy("page_id").orderBy("passage_ord")
    return passages.where(condition).withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most)


def claim_candidates(passages: DataFrame, hints: str = rules.CLAIM_HINTS, most: int = 25) -> DataFrame:
    return first_passages(passages, (F.length("text") > 40) & F.col("text").rlike(T.whole_words(hints)), most)


def shortlist(passages: DataFrame, most: int = 8) -> DataFrame:
    """Passages that may describe the page: paragraphs and list items of 8 to 60 words; key is p1, p2, ..."""
    n = F.size(F.split("text", r"\s+"))
    return first_passages(passages, F.col("kind").isin("paragraph", "listitem") & n.between(8, 60), most).withColumn("key", F.concat(F.lit("p"), F.col("nth")))


def chunks(passages: DataFrame, budget: int) -> DataFrame:
    """Sections cut into chunks of passages in order: a chunk ends before the passage with which its tokens would exceed the
    budget. page_id, section_ord, chunk, first, last (places of the section's passages), tokens."""
    size = F.transform(F.array_sort(F.collect_list(F.struct("passage_ord", "text"))), lambda x: T.estimated_tokens(x["text"]))
    packed = passages.groupBy("page_id", "section_ord").agg(size.alias("sizes"))
    zero = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("tokens")))

    def put(out: Column, t: Column) -> Column:
        last = F.element_at(out, -1)
        more = F.struct(last["first"].alias("first"), (last["n"] + 1).alias("n"), (last["tokens"] + t).alias("tokens"))
        new = F.struct((last["first"] + last["n"]).alias("first"), F.lit(1).alias("n"), t.alias("tokens"))
        head = F.slice(out, F.lit(1), F.size(out) - 1)
        return F.when((last["n"] > 0) & (last["tokens"] + t > budget), F.concat(out, F.array(new))).otherwise(F.concat(head, F.array(more)))

    return packed.select("page_id", "section_ord", F.posexplode(F.aggregate("sizes", zero, put)).alias("chunk", "c")).select("page_id", "section_ord", "chunk", F.col("c.first").alias("first"), (F.col("c.first") + F.col("c.n") - 1).alias("last"), F.col("c.tokens").alias("tokens"))


def budgeted(passages: DataFrame, most: int = 14, chars: int = 1800) -> DataFrame:
    """The first passages of each page, up to `most` and before the first with which their characters exceed `chars`."""
    own = Window.partitionBy("page_id").orderBy("passage_ord")
    upto = F.sum(F.length("text")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = passages.withColumns({"nth": F.row_number().over(own), "upto": upto})
    return rows.where((F.col("nth") <= most) & (F.col("upto") <= chars))

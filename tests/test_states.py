"""States as JSON, read again."""

import json

from pagewright.operators import extract, site, states
from pagewright import rules

PAGE = '<html lang="en"><head><title>T "q"</title></head><body><h1>One</h1><p>First words here.</p><p>Second words.</p><h2>Pricing</h2><p>It is 9 EUR.</p></body></html>'


def read(df, by="page_id"):
    return {(r[by], r["ref_id"]): (json.loads(r["state"]), r["tokens"]) for r in df.collect()}


def test_pages_sections_passages(spark):
    e = extract.extract(spark.createDataFrame([(1, "https://e.com/a", PAGE), (2, "https://e.com/b", None)], "page_id long, url string, html string"))
    got = read(states.page_states(e))
    assert got[1, "page"][0] == {"url": "https://e.com/a", "title": 'T "q"', "meta_description": None, "headings": ["# One", "## Pricing"], "opening_text": "First words here. Second words."}
    assert got[2, "page"][0] == {"url": "https://e.com/b", "title": None, "meta_description": None, "headings": [], "opening_text": ""}
    docs, sections, passages = extract.docs(e), extract.sections(e), extract.passages(e)
    of = {r["heading"]: f"s{r['section_ord']}" for r in sections.where("page_id = 1").collect()}
    whole = read(states.section_states(docs, sections, passages, least=1))
    assert whole[1, of["One"]][0] == {"page_title": 'T "q"', "heading": "One", "heading_level": 1, "text": "First words here.\n\nSecond words."} and len(whole) == 2
    cut = read(states.section_states(docs, sections, passages, least=4, budget=5))
    assert {k: (v["text"], v["part"]) for k, (v, _) in cut.items() if k[1].startswith(of["One"])} == {(1, of["One"] + "#0"): ("First words here.", "1 of 2"), (1, of["One"] + "#1"): ("Second words.", "2 of 2")}
    none = passages.select("page_id", "section_ord").distinct()
    assert states.section_states(docs, sections, passages, none, least=1).collect() == []
    assert read(states.passage_states(passages.where("text LIKE '%EUR%'"), sections)).popitem()[1][0] == {"heading": "Pricing", "text": "It is 9 EUR."}

    bank = rules.questions(spark)
    haystack = passages.groupBy("page_id").agg({"text": "max"}).selectExpr("page_id", "'our pricing' as text", "cast(null as string) as business_type")
    raised = site.raised_questions(haystack, bank)
    kept = site.coverage_passages(passages, sections, raised, bank)
    state, tokens = read(states.coverage_states(docs, extract.headings(e), passages, kept))[1, "coverage"]
    assert state == {"url": "", "title": 'T "q"', "headings": ["One", "Pricing"], "relevant_text": ["It is 9 EUR."]} and tokens == -(-len(json.dumps(state, separators=(",", ":"))) * 2 // 7)


def test_sites_keep_their_first_pages(spark):
    rows = [("e.com", k, f"https://e.com/{k}", None, "saas", ["a"], None, True, None) for k in range(30)]
    df = spark.createDataFrame(rows, "site string, ord long, url string, purpose string, business_type string, terms array<string>, audience_named boolean, has_action boolean, stage string")
    state, _ = read(states.site_states(df), "site")["e.com", "site"]
    assert [p["url"] for p in state["pages"]] == [f"https://e.com/{k}" for k in range(25)] and state["pages"][0]["audience_named"] is None
    assert states.site_states(df.limit(0)).collect() == []

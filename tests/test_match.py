"""Many patterns at once, against plain searches."""

import random
import re

from pagewright import rules
from pagewright.functions import match as M
from pagewright.operators import site
from pyspark.sql import functions as F


def plain_terms(low, terms, limit):
    kept = []
    for k, (t, g) in enumerate(terms):
        m = re.search(rf"(?<![^\W\d_]|-){re.escape(t)}(?![^\W\d_]|-)", low)
        if m and all(abs(m.start() - at) > 1 for at, *_ in kept):
            kept.append((m.start(), k, t, g))
    return [(at + 1, t, g) for at, _, t, g in sorted(kept)[:limit]]


def test_terms_as_one_search_each(spark):
    rng = random.Random(11)
    lexicon = tuple(rules.hype())
    words = [t for t, _ in lexicon] + ["the", "é", "x", "-", "best", "in", "class", ".", ",", "1", " ", "  "]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "-", "", ", "]) for _ in range(rng.randrange(0, 14))) for _ in range(400)] + ["", None, "best" * 50_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(3)
    for limit in (2, 100):
        for r in df.select("t", M.whole_terms(F.lower("t"), lexicon, limit).alias("x")).collect():
            assert [tuple(v) for v in r["x"]] == plain_terms((r["t"] or "").lower(), lexicon, limit)


def test_one_matcher_a_plan(spark):
    df = spark.createDataFrame([("the best",)], "t string").withColumn("x", M.whole_terms(F.lower("t"), (("best", "a"),), 5)).where(F.size("x") > 0).withColumn("n", F.size("x"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("EvalPython [") >= 1 and len(re.findall(r"find\(lower", plan)) == 1


def test_groups_count_different_patterns(spark):
    groups = (("ab", "bc", "ab"), ("abc",), ("zz", "é"))
    df = spark.createDataFrame([("abcab",), ("é",), ("",), (None,), ("a b c",)], "t string")
    got = {r["t"]: [tuple(x) for x in r["x"]] for r in df.select("t", M.group_hits(F.col("t"), groups).alias("x")).collect()}
    assert got == {"abcab": [(0, 2), (1, 1)], "é": [(2, 1)], "": [], None: [], "a b c": []}


def test_raised_questions_and_their_passages(spark):
    bank = rules.questions(spark)
    pages = spark.createDataFrame([(1, "our pricing and a free trial; designed for teams", "saas"), (2, "nothing here", None), (3, "pricing", "nonprofit"), (4, "pricing", None)], "page_id long, text string, business_type string")
    raised = site.raised_questions(pages, bank)
    got = {}
    for r in raised.orderBy("page_id", "nth").collect():
        got.setdefault(r["page_id"], []).append(r["question_id"])
    assert got[1][0] == "q_what_it_costs" or "q_what_it_costs" in got[1]
    assert 2 not in got and 3 not in got and got[4] == ["q_what_it_costs"]
    texts = ["We start here.", "See our pricing.", "It begins at 9 EUR.", "Filler one.", "Filler two.", "Filler three.", "Under a heading.", "More under it.", "Third under it.", "Fourth under it."]
    passages = spark.createDataFrame([(4, 0 if k < 6 else 1, k, t) for k, t in enumerate(texts)] + [(2, 0, 0, "pricing")], "page_id long, section_ord int, passage_ord int, text string")
    sections = spark.createDataFrame([(4, 0, None), (4, 1, "Pricing"), (2, 0, "Pricing")], "page_id long, section_ord int, heading string")
    kept = site.coverage_passages(passages, sections, raised, bank)
    assert [(r["page_id"], r["passage_ord"], r["nth"]) for r in kept.orderBy("passage_ord").collect()] == [(4, 0, 1), (4, 1, 2), (4, 2, 3), (4, 6, 4), (4, 7, 5), (4, 8, 6)]
    assert [r["passage_ord"] for r in site.coverage_passages(passages, sections, raised, bank, chars=35).orderBy("passage_ord").collect()] == [0, 1]

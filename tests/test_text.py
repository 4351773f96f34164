import random
import re

import pytest
from pagewright import rules
from pagewright.functions import text as T
from pagewright.plans import views
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def of(spark):
    """The value of an expression over a text."""

    def get(expression, *values):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, s string").select("k", expression(F.col("s")).alias("x")).collect()
        return [r["x"] for r in sorted(rows, key=lambda r: r["k"])]

    return get


def test_questions_and_promises(of):
    assert of(T.is_question, "Really?", "How it works", "Howard", "What’s new", "Our plans") == [True, True, False, True, False]
    assert of(T.is_promissory, None, "Why", "Why?", "Anna Berg", "Home", "How to set up", "anna berg") == [False, False, True, False, False, True, True]


def test_names(of):
    assert of(T.is_name_like, None, "", "Anna Berg", "Pricing", "Is it?", "one two three four five", "4 things", "Émile Zola") == [True, True, True, False, False, False, False, True]


def test_language_gate(of):
    assert of(T.language_supported, None, "", "EN", "en-GB", "eng", "de") == [True, True, True, True, False, False]


def test_sentences_words_tokens(of):
    assert of(T.sentences, "A b. C d! E", "one") == [["A b.", "C d!", "E"], ["one"]]
    assert of(T.words, " a  b ", "") == [2, 0]
    assert of(T.estimated_tokens, "abcdefgh", "") == [3, 0]
    assert of(T.tokens, "Don't re-do Ünits 3x") == [["don't", "re-do", "ünits", "3x"]]


def test_sentences_keep_the_digits_of_their_places(of):
    assert of(T.sentences, "0 a. Costs 1! x2 2? 1.3", " 0 ", " . ") == [["0 a.", "Costs 1!", "x2 2?", "1.3"], ["0"], ["."]]


def test_hype_prefers_longer_terms_and_whole_words(of):
    terms = lambda s: F.transform(T.hype_terms(s), lambda x: x["term"])
    assert of(terms, "The best-in-class tool, simply the best.", "bestial nest", "A revolutionary, robust thing", "éleading leading") == [["best-in-class", "simply", "best"], [], ["revolutionary", "robust"], ["leading"]]


def test_claims_and_evidence(of):
    assert of(T.claim_kind, "the fastest way", "we boost sales", "nothing here", "a secure and reliable host") == ["performance", "outcome", None, "security"]
    assert of(T.evidence_kinds, "up 40% since 2019", "$5 and a study", "no", "GDPR audited") == [["figure", "timeframe"], ["figure", "source"], [], ["named"]]


def test_whole_words_are_tried_at_their_first_letters_only(of):
    patterns = [p for _, p, _ in rules.CLAIMS] + [rules.TOPIC_WORDS, rules.OPENERS, rules.VAGUE, rules.REVIEWER, rules.COMPANY, r"x?y|[ab|c]d|(e|f)g|\(h|", "#1|no 1"]
    texts = ["Faster", "xfaster", "faster_", "a#1 b", "#1", "a #1", "é" + "easy", "SOC2 soc  2", "no", "no 1", "I've", "xy y", "a|d |d", "eg", "x(h", "results", "set up inn", "always on.", "in minutes", "ſpeed", "", None]
    for p in patterns:
        plain = f"(?i){T.EDGE}(?:{p}){T.EDGE}"
        assert of(lambda s: s.rlike(T.whole_words(p)), *texts) == of(lambda s: s.rlike(plain), *texts), p
    assert not any(T.whole_words(p).startswith(f"(?i){T.EDGE}") for p, *_ in [x[1:] for x in rules.CLAIMS])
    assert of(T.claim_kind, "Robust and faster", "We are a#1", "none", "", None) == ["performance", "leadership", None, None, None]


def test_hash_fill_redaction(of):
    assert of(T.fnv1a, "abc", "") == ["1a47e90b", "811c9dc5"]
    assert of(lambda s: T.filled(s, F.create_map(F.lit("n"), F.lit("3"))), "{n} of {m}, {n}") == ["3 of {m}, 3"]
    assert of(T.redacted, "Bearer abcdefghijklmnopqr1", "x sk-ABCDEFGHIJKLMNOPQ y", "u?key=abc&b=1", "plain") == ["Bearer [redacted]", "x [redacted] y", "u?key=[redacted]&b=1", "plain"]


def test_quotes(of):
    (q,) = of(T.quote, "word " * 80)
    assert len(q) <= 241 and q.endswith("d…") and of(lambda s: T.is_quoted(s, F.lit(q)), "word " * 80, "other") == [True, False]


@pytest.mark.parametrize(("kind", "n", "want"), [("noul", 2, 0.6), ("choice", 2, 0.6), ("choice", 4, 0.5), ("choice", 6, 0.35), ("score", 5, 0.5)])
def test_bars(spark, kind, n, want):
    assert spark.range(1).select(T.needed_confidence(F.lit(kind), F.lit(n)).alias("x")).first()["x"] == pytest.approx(want)


def test_rule_tables_are_complete():
    ids = [c[0] for c in rules.CHECKS]
    assert len(ids) == len(set(ids)) == 48
    assert {t[0] for t in rules.TRIGGERS} <= set(ids) and {x for s in rules.SUBSUMES for x in s} <= set(ids)
    assert set(rules.RECURRING) | set(rules.SITE_LEVEL) <= set(ids)
    assert set(rules.ADVICE) == set(ids) and set(rules.QUESTION_TEXTS) == {q[0] for q in rules.QUESTIONS} and set(rules.STAGE_TEXTS) == set(rules.STAGES)
    assert len(rules.QUESTIONS) == 15 and len({q[1] for q in rules.QUESTIONS}) == 10
    assert all(c[3] in range(5) and c[2] in ("high", "medium", "low") for c in rules.CHECKS)


def test_no_confidence_and_no_yes_or_no_is_none(spark):
    rows = spark.createDataFrame([(None, None), (None, 0.25), (0.3, None), (None, 0.5)], "c double, n double")
    assert [r[0] for r in rows.select(T.answer_confidence(F.col("c"), F.col("n"))).collect()] == [0.0, 0.5, 0.3, 0.0]


def test_evidence_and_white_space_as_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["12", "4%", "$9", " ", "  ", "\t", "\u00a0", "\n\n", "x", "_", "-", ".", "é", "soc2", "SOC 2", "cited", "source:", "is", "in 2019", "Q3 2020", "iso27001", "docs", "9 days"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(7))) for _ in range(600)]
    kinds = (*rules.EVIDENCE, ("digit", r"\b\d"), ("maybe", r"x\b\d?-"), ("verb", r"\b(is|was|est)\b"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.evidence_kinds(F.col("t"), kinds).alias("e"), T.collapse(F.col("t")).alias("c"))
    for r in df.collect():
        assert r["e"] == [k for k, p in kinds if re.search(p, r["t"], re.ASCII | re.IGNORECASE)], r["t"]
        assert r["c"] == re.sub(r"\s+", " ", r["t"], flags=re.ASCII).strip(" ")


def test_white_space_of_lines_is_collapsed_once(spark, sf):
    plan = views.lines(spark, sf).select("page_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert sum(line.count("regexp_replace(") for line in plan.splitlines() if "FileScan" not in line) == 1

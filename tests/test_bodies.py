"""Request bodies against a plain reading of the same JSON; texts of plans, names of sections."""

import json
import random

from pagewright import rules
from pagewright.functions import text as T
from pagewright.operators import bodies as B
from pagewright.operators import report as P
from pagewright.operators import site as R
from pyspark.sql import functions as F


def summary(k: int, **other) -> dict:
    return {"url": f"https://a.example/{k}", "title": None, "purpose": "sell", "businessType": None, "topicTerms": ["x"], "audienceNamed": False, "hasAction": False, "journeyStage": None, "findingCounts": {"count": 2, "high": 1}} | other


def outcome(k: int, **other) -> dict:
    return {"id": "f1", "text": "We help teams", "pageUrl": f"https://a.example/{k}", "found": False} | other


def finding(k: int, **other) -> dict:
    return {"id": f"vague_claim:{k}", "checkId": "vague_claim", "module": "evidence_trust", "pageUrl": f"https://a.example/{k}"} | other


def plain(value, kind: str) -> bool:
    """Whether a JSON value, read by Python, is of a kind."""
    if kind == "flag":
        return isinstance(value, bool)
    if kind == "whole":
        return isinstance(value, int | float) and not isinstance(value, bool) and value >= 0 and value == int(value)
    if kind == "texts":
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    return isinstance(value, str)


def right_summary(x) -> bool:
    if not isinstance(x, dict):
        return False
    nullable = {"title", "purpose", "businessType", "audienceNamed", "journeyStage"}
    kinds = {"url": "text", "title": "text", "purpose": "text", "businessType": "text", "topicTerms": "texts", "audienceNamed": "flag", "hasAction": "flag", "journeyStage": "text"}
    for name, kind in kinds.items():
        if name not in x or not (plain(x[name], kind) or (x[name] is None and name in nullable)):
            return False
    counts, covered = x.get("findingCounts"), x.get("coverage")
    if not isinstance(counts, dict) or not all(plain(counts.get(n), "whole") for n in ("count", "high")):
        return False
    return covered is None or (isinstance(covered, dict) and all(plain(covered.get(n), "texts") for n in ("raised", "answered")))


def test_summaries_as_read_by_hand(spark):
    rng = random.Random(3)
    strange = [None, "x", "", 3, 3.0, 2.5, -1, 1e2, True, [], ["a"], ["a", None], {}, {"raised": [], "answered": ["q"]}, {"raised": []}, {"count": 1, "high": 0}, {"count": 1.0, "high": "0"}]
    given = []
    for k in range(300):
        items = [summary(n) for n in range(rng.choice((0, 2, 3, 25, 26)))]
        for _ in range(rng.choice((0, 1, 1, 2))):
            if items:
                x = rng.choice(items)
                name = rng.choice([*x, "coverage", "unknown"])
                if rng.random() < 0.2:
                    x.pop(name, None)
                else:
                    x[name] = rng.choice(strange)
        given.append((k, json.dumps({"summaries": items, "more": 1})))
    got = {r["body_id"]: r for r in B.site_requests(spark.createDataFrame(given, "body_id int, body string")).collect()}
    for k, body in given:
        items = json.loads(body)["summaries"]
        state = "too_many" if len(items) > 25 else "ok" if all(map(right_summary, items)) else "invalid"
        assert got[k]["summaries_state"] == state, body
        assert [x["url"] for x in got[k]["summaries"]] == ([x["url"] for x in items] if state == "ok" else [])
    assert len({got[k]["summaries_state"] for k, _ in given}) == 3


def test_bodies_of_all_kinds(spark):
    whole = {"summaries": [summary(k) for k in range(3)]}
    one = lambda **x: json.dumps(whole | x)
    cases = [
        (None, 400, "absent", "absent", "absent"), ("", 400, "absent", "absent", "absent"), ("nope", 400, "absent", "absent", "absent"), ("[1]", 400, "absent", "absent", "absent"), ('{"summaries":{"0":1}}', 400, "invalid", "absent", "absent"),
        ('{"summaries":[],"summaries":[]}', 400, "absent", "absent", "absent"), ('{"summaries":[]}', 200, "ok", "absent", "absent"), (one(), 200, "ok", "absent", "absent"), (one(focus=None, findings=3), 200, "ok", "invalid", "invalid"),
        (one(focus=[outcome(1)], findings=[finding(1)]), 200, "ok", "ok", "ok"), (one(focus=[outcome(1, id="")]), 200, "ok", "invalid", "absent"), (one(focus=[outcome(1, id="f" * 21)]), 200, "ok", "invalid", "absent"),
        (one(focus=[outcome(1, pageUrl="no address")]), 200, "ok", "invalid", "absent"), (one(focus=[outcome(1, pageUrl="https://")]), 200, "ok", "invalid", "absent"), (one(focus=[outcome(1, found=1)]), 200, "ok", "invalid", "absent"),
        (one(focus=[outcome(k) for k in range(75)]), 200, "ok", "ok", "absent"), (one(focus=[outcome(k) for k in range(76)]), 200, "ok", "too_many", "absent"), (one(findings=[finding(k) for k in range(500)]), 200, "ok", "absent", "ok"),
        (one(findings=[finding(k) for k in range(501)]), 200, "ok", "absent", "too_many"), (one(findings=[finding(1), finding(2, module="misc")]), 200, "ok", "absent", "invalid"), (one(findings=[finding(1), "x"]), 200, "ok", "absent", "invalid"),
        (json.dumps({"summaries": [summary(1, title="x" * 200_000)] * 3}), 200, "ok", "absent", "absent"),
    ]
    rows = spark.createDataFrame([(k, c[0], "extra") for k, c in enumerate(cases)], "body_id int, body string, status string")
    got = B.site_requests(rows).orderBy("body_id").collect()
    assert [(r["status"], r["summaries_state"], r["outcomes_state"], r["findings_state"]) for r in got] == [c[1:] for c in cases]
    assert all(r["outcomes"] == [] for r in got if r["outcomes_state"] != "ok") and [len(r["findings"]) for r in got if r["findings_state"] == "ok"] == [1, 500]
    assert B.site_requests(rows.limit(0)).collect() == []
    assert [r["limit"][-3:] for r in B.too_few(B.site_requests(rows)).collect()] == [" 0."]


def test_answers_to_a_body(spark):
    body = {"summaries": [summary(k, coverage={"raised": ["q_support"], "answered": []}) for k in range(4)], "focus": [outcome(k) for k in range(4)], "findings": [finding(k) for k in range(3)]}
    few = {"summaries": [summary(k) for k in range(2)], "findings": [finding(k) for k in range(9)]}
    r = B.site_requests(spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps(few)), (3, "{")], "body_id int, body string"))
    found, plan = B.site_answers(r, rules.checks(spark), rules.questions(spark), rules.question_texts(spark), rules.stage_texts(spark))
    assert {(x["site"], x["check_id"]) for x in found.collect()} == {(1, c) for c in ("audience_rarely_named", "site_has_no_next_step", "site_sells_without_explaining", "question_unanswered_sitewide", "focus_not_communicated_sitewide")}
    told = {x["subject"]: x["reason"] for x in R.plan_told(plan, rules.plan_texts(spark)).collect()}
    assert told["vague_claim"] == "On 3 pages claims give neither figure nor condition." and "question_unanswered_sitewide" in told


def test_bodies_about_one_page(spark):
    cases = [
        ('{"url":" Example.COM/a#b "}', "https://example.com/a", None, [], False), ('{"url":""}', None, "invalid_url", [], False), ('{"url":5}', None, "invalid_url", [], False), ("{", None, "invalid_url", [], False), (None, None, "invalid_url", [], False),
        ('{"url":"http://10.0.0.1/"}', None, "blocked_url", [], False), ('{"url":"a.example","focus":[" seven77 ","eight888",8,["eight888"],"' + "x" * 201 + '"],"partOfScan":true}', "https://a.example/", None, ["eight888"], True),
        ('{"url":"a.example","focus":"eight888","partOfScan":"true"}', "https://a.example/", None, [], False),
    ]
    got = B.page_requests(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "body_id int, body string")).orderBy("body_id").collect()
    assert [(r["url"], r["error_code"], r["focuses"], r["part_of_scan"]) for r in got] == [c[1:] for c in cases]


def test_every_job_has_a_text(spark):
    assert set(rules.RECURRING_TEXTS) == set(rules.RECURRING) and set(rules.SITE_TEXTS) == set(rules.SITE_LEVEL) and set(rules.AREA_TEXTS) == {q[1] for q in rules.QUESTIONS}
    jobs = spark.createDataFrame([("s", "recurring:vague_claim", "recurring", "vague_claim", 2), ("s", "area:pricing", "area", "pricing", 3), ("s", "site:x", "site", "none such", 1)], "site string, job_id string, kind string, subject string, n long")
    assert [r["reason"] for r in R.plan_told(jobs, rules.plan_texts(spark), single_page=True).orderBy("job_id").collect()] == ["3 questions about its price are open; they are one missing subject.", "2 claims of the page give neither figure nor condition."]


def test_section_names_headlines_and_hashes(spark):
    sections = spark.createDataFrame([(1, 0, "Prices"), (1, 1, ""), (1, 2, None), (2, 0, "Other"), (1, 0, "Prices")], "page_id int, section_ord int, heading string")
    findings = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 7), (1, None), (3, 0), (1, 0)], "page_id int, section_ord int")
    assert sorted(r["section"] for r in P.section_names(findings, sections).collect()) == ["Prices", "Prices", "Section 0", "Section 1", "Section 2", "Section 7", "This page"]
    said = spark.createDataFrame([("“How” does not say", 3), ("It is short.", 2), ("“How” does not say", 1), ('"Why" reads badly', 2)], "o string, n int")
    assert [r[0] for r in said.select(P.headline(F.col("o"), F.col("n"))).collect()] == ["3 sections do not say", "It is short. (2 places)", "“How” does not say", "2 sections read badly"]

    def fnv(s: str) -> str:
        h, data = 0x811C9DC5, s.encode("utf-16-be")
        for k in range(0, len(data), 2):
            h = (h ^ int.from_bytes(data[k : k + 2], "big")) * 0x01000193 % (1 << 32)
        return f"{h:08x}"

    texts = ["", "a", "naïve", "日本語", "a😀b", "￾\x00"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.fnv1a(F.col("t"))).collect()] == [fnv(t) for t in texts]

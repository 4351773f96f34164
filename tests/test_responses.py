"""Responses of decision services: what is refused, and where it says that they are wrong."""

import json

from pagewright.operators import decide, responses


def test_right_and_wrong_responses(spark):
    one = {"type": "noul", "noul": 0.75}
    two = {"type": "choice", "choice": "a", "probabilities": {"a": 1, "b": 0.0, "c": 0}, "legend": {"a": "A"}, "confidence": 1}
    cases = [
        ({"answers": {}}, None), ({"answers": {"q": one}, "more": 1}, None), ({"model": "m", "answers": {"q": one, "r": two}, "usage": {"input_tokens": 3}}, None), ({"answers": {"q": {"type": "score", "score": 2.5}}, "usage": {}}, None),
        ({"answers": {"q": one | {"noul": -0.01}}}, "answers.q.noul"), ({"answers": {"q": one | {"noul": "0.5"}}}, "answers.q.noul"), ({"answers": {"q": one | {"noul": None}}}, "answers.q.noul"), ({"answers": {"q": {"noul": 0.5}}}, "answers.q.type"),
        ({"answers": {"q": {"type": "Noul"}}}, "answers.q.type"), ({"answers": {"q": 3, "r": None, "s": [], "t": two}}, "answers.q, answers.r, answers.s"), ({"answers": {"r": two | {"confidence": 1.5, "choice": 1}}}, "answers.r.choice, answers.r.confidence"),
        ({"answers": {"r": two | {"probabilities": {"a": "1"}}}}, "answers.r.probabilities"), ({"answers": {"r": two | {"probabilities": [1]}}}, "answers.r.probabilities"), ({"answers": {"r": two | {"legend": {"a": None}}}}, "answers.r.legend"),
        ({"answers": []}, "answers"), ({"model": None}, "model, answers"), ({"answers": {}, "usage": 3}, "usage"), ({"answers": {}, "usage": None}, "usage"), ({"answers": {}, "usage": {"output_tokens": -1, "input_tokens": True}}, "usage.input_tokens, usage.output_tokens"),
        ({"answers": {"q": one | {"choice": "x" * 100_000}}}, None), ([], ""), ("text", ""),
    ]
    rows = [(k, "page", "page", json.dumps(c), "extra") for k, (c, _) in enumerate(cases)] + [(98, "page", "page", "{", "x"), (99, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, scope string, ref_id string, body string, reason string")
    checked = responses.validated(df)
    got = {r["page_id"]: r for r in checked.collect()}
    for k, (c, places) in enumerate(cases):
        assert got[k]["reason"] == (None if places is None else f"malformed response: {places}"), c
        assert (got[k]["answers"] is None) == (places is not None)
    assert got[98]["reason"] == got[99]["reason"] == "malformed response: "
    assert (got[2]["model"], got[2]["input_tokens"], got[2]["output_tokens"], got[1]["model"]) == ("m", 3.0, 0.0, "unknown")
    said = {(r["page_id"], r["question_id"]): r for r in responses.answers(checked).collect()}
    assert (said[2, "q"]["confidence"], said[2, "q"]["n_options"], said[2, "r"]["confidence"], said[2, "r"]["n_options"], said[3, "q"]["confidence"]) == (0.5, None, 1.0, 3, 0.0)
    assert {(r["page_id"], r["question_id"]) for r in decide.confident(responses.answers(checked)).collect()} == {(2, "r")}
    assert responses.validated(df.limit(0)).collect() == []


def test_each_body_is_parsed_once(spark):
    checked = responses.validated(spark.createDataFrame([(1, "page", "page", "{}")], "page_id long, scope string, ref_id string, body string"))
    for df in (checked, responses.answers(checked)):
        assert df._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1

"""Incremental audits against batch audits, and the bounded queue of decision calls."""

import threading
import time

import pytest
from pagewright.operators import audit, decide
from pagewright.streaming import scan
from pyspark.errors import PythonException
from pyspark.sql import functions as F

KIND = "page_id long, url string, html string"


def page(k, words, links=""):
    return f"<html><head><title>Page number {k}</title></head><body><h1>About {k}</h1>{links}" + "".join(f"<p>{w}</p>" for w in words) + "</body></html>"


def by_batch(pages):
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    got = audit.page_summaries(pages).groupBy(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("site")).agg(F.count("*").alias("pages"), F.sum("findings").alias("findings"), F.sum("high").alias("high"), F.sum(F.col("has_action").cast("long")).alias("acts"))
    return sorted(map(tuple, got.collect()))


def test_pages_seen_again_replace_their_summaries(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "state")
    act = '<a href="/x">Get started today</a>'
    first = [(k, f"https://www.s{k % 2}.example/{k}", page(k, ["Some words."] * (k + 1), act if k % 3 == 0 else "")) for k in range(6)]
    later = [(2, first[2][1], page(2, ["Other words."], act)), (3, first[3][1], "<p>x"), (9, "https://a.s1.example/9", page(9, ["New."])), (10, "https://a.s1.example/9", page(10, ["Newer."], act)), (11, None, "<p>no url")]
    df = lambda rows: spark.createDataFrame(rows, KIND).coalesce(1)
    df(first).write.parquet(source)
    assert sorted(map(tuple, scan.audit_scan(spark, source, target).collect())) == by_batch(df(first))
    df(first[:2]).write.mode("append").parquet(source)  # replayed as it was
    df(later).write.mode("append").parquet(source)
    now = {u: (k, u, h) for k, u, h in [*first, *later] if u}
    want = by_batch(df(list(now.values())))
    assert sorted(map(tuple, scan.audit_scan(spark, source, target, files=1).collect())) == want
    assert sorted(map(tuple, scan.audit_scan(spark, source, target).collect())) == want  # nothing new
    # The last batch is run again after a failure: the same counts.
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state" / "sites").iterdir())
    scan.take_in(df(first[:2]) if last == 1 else df(later), last, target, scan.audited)
    assert sorted(map(tuple, scan.site_counts(spark, target).collect())) == want


STATES = "page_id long, scope string, ref_id string, state string, questions array<string>, priority int"


def echo():
    """A class that workers get by value."""

    class Echo:
        def decide(self, state, questions):
            return {q: {"atype": "noul", "noul": 0.9, "confidence": 0.8} for q in questions if q != "unknown"}

    return Echo


def test_a_page_has_a_budget_in_its_order(spark):
    rows = [(1, "section", f"s{k}", "x", ["a"], None) for k in range(12)] + [(1, "page", "page", "x", ["a", "unknown"], None), (1, "passage", "3", "x", ["a"], 0), (2, "section", "s1", None, ["a"], None), (2, "section", "s1", None, [], None)]
    got = decide.calls(spark.createDataFrame(rows, STATES), echo(), budget=5).collect()
    asked = {(r["page_id"], r["ref_id"], r["question_id"]): r["reason"] for r in got}
    assert {k for k, v in asked.items() if v is None} == {(1, "3", "a"), (1, "page", "a"), (1, "s0", "a"), (1, "s1", "a"), (1, "s2", "a"), (2, "s1", "a")}
    assert asked[1, "page", "unknown"] == "no_answer" and asked[1, "s3", "a"] == "budget" and len(got) == 16
    assert all(r["confidence"] == 0.0 for r in got if r["reason"])


def test_outages_end_a_tasks_calls_and_faults_end_the_task(spark):
    class Down:
        def decide(self, state, questions):
            if state == "down":
                raise decide.Unavailable("503")
            return {q: {"atype": "noul", "noul": 0.9, "confidence": 0.8} for q in questions}

    class Faulty:
        def decide(self, state, questions):
            raise KeyError("a bug")

    rows = [(k, "page", "page", "down" if k == 3 else "x", ["a"], 0) for k in range(8)]
    states = spark.createDataFrame(rows, STATES).repartition(1)
    got = sorted((r["page_id"], r["reason"]) for r in decide.calls(states, Down, concurrent=1).coalesce(1).collect())
    assert (3, "outage: 503") in got and {r for _, r in got} == {None, "outage: 503"}
    with pytest.raises(PythonException, match="a bug"):
        decide.calls(states, Faulty).collect()


def test_calls_are_open_side_by_side_up_to_a_bound(spark):
    class Slow:
        def __init__(self):
            self.open, self.most, self.lock = 0, 0, threading.Lock()

        def decide(self, state, questions):
            with self.lock:
                self.open += 1
                self.most = max(self.most, self.open)
            time.sleep(0.05)
            with self.lock:
                self.open -= 1
            return {q: {"atype": "score", "score": float(self.most), "confidence": 1.0} for q in questions}

    rows = [(k, "page", "page", "x", ["a"], 0) for k in range(24)]
    got = decide.calls(spark.createDataFrame(rows, STATES).repartition(1), Slow, concurrent=4).collect()
    assert 1 < max(r["score"] for r in got) <= 4

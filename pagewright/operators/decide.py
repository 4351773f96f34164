"""Decisions: states that questions are asked about, providers of answers, and the gate that drops unsure ones.

answers: page_id, scope, ref_id, question_id, atype (noul, choice or score), noul, choice, score, n_options, confidence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

ANSWERS = "page_id long, scope string, ref_id string, question_id string, atype string, noul double, choice string, score double, n_options int, confidence double"


class DecisionProvider(Protocol):
    """Answers questions about one state; made once a task, so that it may hold a connection."""

    def decide(self, state: str, questions: list[str]) -> dict[str, dict]: ...


def fixture_key(state, questions):
    """The key under which answers to these questions about this state (JSON) are recorded."""
    return T.fnv1a(F.concat(state, F.lit("|"), F.array_join(F.array_sort(questions), ",")))


def fixture_digest(state, questions):
    """A digest of the whole question: that of another state or other questions differs, where keys of 32 bits meet by chance."""
    return F.sha2(F.to_json(F.concat(F.array(state), F.array_sort(questions))).cast("binary"), 256)


def replayed(states: DataFrame, recorded: DataFrame) -> DataFrame:
    """Answers recorded under each state's key; questions without one get an answer of confidence 0.

    states: page_id, scope, ref_id, state, questions (array). recorded: key, question_id, an answer's columns and, in tables of
    tens of thousands of states and more, digest (fixture_digest()): with it an answer is that of the very state. Of answers
    that are recorded repeatedly under one key (and digest) the least counts, so that each question has one row.
    """
    by = [("key", fixture_key), ("digest", fixture_digest)][: 2 if "digest" in recorded.columns else 1]
    on = [*[n for n, _ in by], "question_id"]
    asked = states.withColumns({n: f(F.col("state"), F.col("questions")) for n, f in by}).select("page_id", "scope", "ref_id", *on[:-1], F.explode("questions").alias("question_id"))
    told = recorded.groupBy(*on).agg(F.min(F.struct("atype", "noul", "choice", "score", "n_options", "confidence")).alias("a")).select(*on, "a.*")
    return asked.join(told, on, "left").select("page_id", "scope", "ref_id", "question_id", F.coalesce("atype", F.lit("noul")).alias("atype"), "noul", "choice", "score", "n_options", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


class Unavailable(Exception):
    """A provider raises this, or any OSError, when it can't be reached: asking on would fail the same way."""


#: Calls for a page, and calls that a task has open at a time; the order in which a page's states are asked.
BUDGET, CONCURRENT = 14, 14
SCOPES = ("page", "section", "passage")
CALLS = ANSWERS + ", reason string"


def calls(states: DataFrame, make: Callable[[], DecisionProvider], budget: int | None = BUDGET, concurrent: int = CONCURRENT) -> DataFrame:
    """Answers of a provider to all questions about all states, and the reason why a question has none; columns as in CALLS.

    states: page_id, scope, ref_id, state, questions, and priority (the smallest first; without the column all are equal). A
    page gets `budget` calls, one a state: by priority, then scope, then ref; its other states go unanswered (`budget`). Without a
    budget states are asked as they are dealt and ordered. A task
    has at most `concurrent` calls open. After the provider's first outage a task asks no more (`outage: ...`); what it hasn't
    answered of a call it made is `no_answer`. Any other error of a provider is its own fault, and fails the task.

    Null states and states without questions: as any other, and none. Repeated states are asked each.
    """
    first = F.col("priority") if "priority" in states.columns else F.lit(0)
    known = F.array_position(F.array(*[F.lit(x) for x in SCOPES]), F.col("scope"))
    own = Window.partitionBy("page_id").orderBy(first.asc_nulls_last(), F.when(known > 0, known).otherwise(len(SCOPES) + 1), F.length("ref_id"), "ref_id")
    asked = F.lit(True) if budget is None else F.row_number().over(own) <= budget
    queue = states.withColumn("_asked", asked).select("page_id", "scope", "ref_id", "state", "questions", F.col("_asked").alias("asked"))

    def run(batches: Iterator) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        provider, down = make(), []

        def call(s) -> tuple[dict, str | None]:
            if not s.asked:
                return {}, "budget"
            if down:
                return {}, down[0]
            try:
                return provider.decide(s.state, list(s.questions)), None
            except (Unavailable, OSError) as e:
                down.append(f"outage: {e}")
                return {}, down[0]

        with ThreadPoolExecutor(concurrent) as pool:
            for batch in batches:
                states_, rows = list(batch.itertuples()), []
                for s, (got, reason) in zip(states_, pool.map(call, states_), strict=True):
                    for q in s.questions if s.questions is not None else ():
                        a = got.get(q, {})
                        rows.append((s.page_id, s.scope, s.ref_id, q, a.get("atype", "noul"), a.get("noul"), a.get("choice"), a.get("score"), a.get("n_options"), a.get("confidence", 0.0), None if a else reason or "no_answer"))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CALLS.split(", ")])

    return queue.mapInPandas(run, CALLS)


def decided(states: DataFrame, make: Callable[[], DecisionProvider]) -> DataFrame:
    """Answers of a provider, a state at a time; after its first outage a task's other states go unanswered. Columns as in
    ANSWERS; calls() has budgets, calls side by side, and reasons."""
    return calls(states, make, budget=None, concurrent=1).drop("reason")


def confident(answers: DataFrame, bar: float = 0.6) -> DataFrame:
    """Answers whose confidence reaches the bar of their kind; others are dropped, never repaired."""
    sure = T.answer_confidence(F.col("confidence"), F.when(F.col("atype") == "noul", F.col("noul")))
    return answers.withColumn("confidence", sure).where(F.col("confidence") >= T.needed_confidence(F.col("atype"), F.coalesce("n_options", F.lit(2)), bar))


def merged_chunks(answers: DataFrame) -> DataFrame:
    """Of the answers about a section's chunks (`ref#0`, `ref#1`, ...) those of the lowest chunk, under the section's id."""
    base, chunk = F.substring_index("ref_id", "#", 1), F.coalesce(F.regexp_extract("ref_id", r"#(\d+)$", 1).try_cast("int"), F.lit(0))
    own = Window.partitionBy("page_id", "scope", "base", "question_id").orderBy("chunk")
    rows = answers.withColumns({"base": base, "chunk": chunk})
    return rows.withColumn("nth", F.row_number().over(own)).where("nth = 1").withColumn("ref_id", F.col("base")).drop("base", "chunk", "nth")


def triggered(answers: DataFrame, labels: DataFrame, rules: DataFrame) -> DataFrame:
    """Checks that confident answers trigger: page_id, check_id, scope, ref_id, label, confidence.

    rules as rules.triggers(); labels: page_id, scope, ref_id, label (the heading). Some rules need a promising heading.
    """
    met = answers.join(F.broadcast(rules), ["scope", "question_id"]).join(labels, ["page_id", "scope", "ref_id"], "left")
    op, number = F.col("op"), F.col("operand").try_cast("double")
    fires = F.when(op == "noul<", F.col("noul") < number).when(op == "choice=", F.col("choice") == F.col("operand")).when(op == "score>=", F.col("score") >= number).when(op == "score<", F.col("score") < number)
    return met.where(fires & (~F.col("promissory") | T.is_promissory(F.col("label")))).select("page_id", "check_id", "scope", "ref_id", "label", "confidence")


def claim_gate(passages: DataFrame, answers: DataFrame) -> DataFrame:
    """Passages but for those that a confident answer says are no claim."""
    denied = confident(answers.where("question_id = 'is_claim'")).where("noul < 0.5").select("page_id", "ref_id").distinct()
    return passages.join(denied, ["page_id", "ref_id"], "left_anti")


def agreement(expected: DataFrame, answers: DataFrame, bar: float = 0.6) -> DataFrame:
    """By question: n, right, false_positives (said yes, no was right) and overconfident (wrong with 0.85 and more).

    expected: case_id, question_id, expect (boolean, null: should hedge); answers: case_id, question_id, noul, confidence.
    """
    met = expected.join(answers, ["case_id", "question_id"])
    sure = T.answer_confidence(F.col("confidence"), F.col("noul"))
    said = F.when(sure >= bar, F.col("noul") >= 0.5)
    right = said.eqNullSafe(F.col("expect"))
    return met.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(right).alias("agreed"), F.count_if(said & F.coalesce(~F.col("expect"), F.lit(True))).alias("false_positives"), F.count_if(~right & (sure >= 0.85)).alias("overconfident"))


def of_claims(sure: DataFrame) -> DataFrame:
    """Confident answers but for those to passages of which one of them says that they are no claims."""
    no = sure.where("scope = 'passage' AND question_id = 'is_claim' AND noul < 0.5").select("page_id", "scope", "ref_id").distinct()
    return sure.join(no, ["page_id", "scope", "ref_id"], "left_anti")


def improvements(sure: DataFrame, passages: DataFrame) -> DataFrame:
    """page_id, passage_ord and improvement_type of each passage that confident answers speak of: what they say of its section,
    else of the passage itself; null where they say neither."""
    said = sure.where("scope = 'passage'").select("page_id", F.col("ref_id").cast("int").alias("passage_ord"), F.when(F.col("question_id") == "improvement_type", F.col("choice")).alias("own"))
    own = said.groupBy("page_id", "passage_ord").agg(F.max("own").alias("own"))
    kind = sure.where("scope = 'section' AND question_id = 'improvement_type'").select("page_id", F.substring(F.split_part("ref_id", F.lit("#"), F.lit(1)), 2, 9).cast("int").alias("section_ord"), F.col("choice").alias("of_section"))
    kind = kind.groupBy("page_id", "section_ord").agg(F.max("of_section").alias("of_section"))
    placed = own.join(passages.select("page_id", "passage_ord", "section_ord"), ["page_id", "passage_ord"])
    return placed.join(kind, ["page_id", "section_ord"], "left").select("page_id", "passage_ord", F.coalesce("of_section", "own").alias("improvement_type"))

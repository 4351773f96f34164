"""Responses of decision services, read as VARIANT: one that isn't right is refused as a whole, with the places that are wrong.

A table of responses has page_id, scope, ref_id and body (text). Types are strict, and what may be missing may not be null.
Repeated rows are judged each; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T

from .bodies import NUMBER

KINDS = ("noul", "choice", "score")
REF = ["page_id", "scope", "ref_id"]


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)  # null if it's missing


def _number(value: Column, least: float | None = None, most: float | None = None) -> Column:
    n = F.try_variant_get(value, "$", "double")
    right = _kind(value).rlike(NUMBER)
    if least is not None:
        right &= n >= least
    return right if most is None else right & (n <= most)


def _record(value: Column, right) -> Column:
    """An object all of whose values are right."""
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    return T.let(F.map_values(fields), lambda xs: xs.isNotNull() & F.forall(xs, right))


def _fields(value: Column, *names: str) -> Column:
    """The fields of an object, taken out at once: each null if it's missing, and all null for what isn't an object."""
    return F.try_variant_get(value, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")


def _wrong(checks: list[tuple[Column, Column, bool]]) -> Column:
    """The paths whose value isn't right, in order, from (path, right, needed) and null for right where it is missing."""
    said = [F.when(~F.coalesce(right, F.lit(not needed)), path) for path, right, needed in checks]
    return F.filter(F.array(*said), lambda p: p.isNotNull())


def _if_there(value: Column, right: Column) -> Column:
    """Null for a missing value, else whether it's right."""
    return F.when(value.isNotNull(), F.coalesce(right, F.lit(False)))


def _answer_faults(path: Column, f: Column) -> Column:
    """The paths of an answer, of its fields, that are wrong."""
    place = lambda name: F.concat(path, F.lit("." + name))
    text = lambda v: _kind(v) == "STRING"
    own = _wrong([
        (place("type"), text(f["type"]) & F.try_variant_get(f["type"], "$", "string").isin(*KINDS), True),
        (place("noul"), _if_there(f["noul"], _number(f["noul"], 0, 1)), False),
        (place("choice"), _if_there(f["choice"], text(f["choice"])), False),
        (place("score"), _if_there(f["score"], _number(f["score"])), False),
        (place("probabilities"), _if_there(f["probabilities"], _record(f["probabilities"], lambda x: _number(x))), False),
        (place("legend"), _if_there(f["legend"], _record(f["legend"], text)), False),
        (place("confidence"), _if_there(f["confidence"], _number(f["confidence"], 0, 1)), False),
    ])
    return F.when(f.isNotNull(), own).otherwise(F.array(path))


def validated(responses: DataFrame, unknown: str = "unknown") -> DataFrame:
    """page_id, scope, ref_id, model, input_tokens, output_tokens, reason (null for a right response) and answers.

    reason: `malformed response: ` and the paths that are wrong: model, each answer by its question (in the order of their
    names), usage. Tokens that aren't told are 0. An answer without a confidence has that of its yes or no (its distance from the
    middle), else 0. n_options is the number of probabilities. Values are never mended: one wrong answer refuses them all.
    """

    def judged(e: Column) -> Column:
        fields = _fields(e["value"], "type", "noul", "choice", "score", "probabilities", "legend", "confidence")
        return T.let(fields, lambda f: F.struct(e["key"].alias("key"), f.alias("f"), _answer_faults(F.concat(F.lit("answers."), e["key"]), f).alias("faults")))

    def answer(x: Column) -> Column:
        get = lambda name, kind: F.try_variant_get(x["f"][name], "$", kind)
        noul = get("noul", "double")
        return F.struct(
            x["key"].alias("question_id"), get("type", "string").alias("atype"), noul.alias("noul"), get("choice", "string").alias("choice"), get("score", "double").alias("score"),
            F.map_keys(get("probabilities", "map<string,double>")).alias("options"), T.answer_confidence(get("confidence", "double"), noul).alias("confidence"),
        )

    tokens = ("input_tokens", "output_tokens")

    def parted(v: Column) -> Column:
        """The parts of a response; whole is null if it's no object."""
        said = F.transform(F.map_entries(F.try_variant_get(v["answers"], "$", "map<string,variant>")), judged)
        return F.struct(v.isNotNull().alias("whole"), v["model"].alias("model"), v["usage"].alias("usage"), _fields(v["usage"], *tokens).alias("counts"), said.alias("said"))

    def faulty(p: Column) -> Column:
        counts = [(F.lit(f"usage.{n}"), _if_there(p["counts"][n], _number(p["counts"][n], 0)), False) for n in tokens]
        faults = F.concat(
            _wrong([(F.lit("model"), _if_there(p["model"], _kind(p["model"]) == "STRING"), False)]),
            F.when(p["said"].isNull(), F.array(F.lit("answers"))).otherwise(F.flatten(F.transform(p["said"], lambda x: x["faults"]))),
            F.when(p["usage"].isNotNull() & p["counts"].isNull(), F.array(F.lit("usage"))).otherwise(_wrong(counts)),
        )
        return F.struct(p.alias("p"), F.when(p["whole"], faults).otherwise(F.array(F.lit(""))).alias("faults"))

    def told(x: Column) -> Column:
        p, right = x["p"], F.size(x["faults"]) == 0
        return F.struct(
            F.when(right, F.coalesce(F.try_variant_get(p["model"], "$", "string"), F.lit(unknown))).alias("model"),
            *[F.when(right, F.coalesce(F.try_variant_get(p["counts"][n], "$", "double"), F.lit(0.0))).alias(n) for n in tokens],
            F.when(~right, F.concat(F.lit("malformed response: "), F.array_join(x["faults"], ", "))).alias("reason"), F.when(right, F.transform(p["said"], answer)).alias("answers"),
        )

    value = _fields(F.try_parse_json("body"), "model", "answers", "usage")
    x = T.let(T.let(T.let(value, parted), faulty), told)  # one expression, so that no filter on a part of it parses a body again for each of its fields
    return responses.select(*REF, x.alias("x")).select(*REF, "x.*")


def answers(checked: DataFrame) -> DataFrame:
    """The answers of right responses, as the gate takes them (decide.ANSWERS)."""
    said = F.coalesce("answers", F.array())  # of a bare column, Spark would first filter the rows that have some, judging each response once more
    rows = checked.select(*REF, F.explode(said).alias("a")).select(*REF, "a.*")
    return rows.select(*REF, "question_id", "atype", "noul", "choice", "score", F.when(F.col("options").isNotNull(), F.size("options")).alias("n_options"), "confidence")

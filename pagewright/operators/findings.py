"""Findings: rules joined with signals, verified quotes, subsumption, order and summaries.

A finding: page_id, finding_id, check_id, module, priority, tier, ref (section or passage; `page`), observation, quotes,
confidence.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions import text as T


def from_signals(signals: DataFrame, checks: DataFrame, passages: DataFrame) -> DataFrame:
    """Findings of signals (page_id, check_id, slots, evidence): the check's text filled, its evidence quoted.

    A quote is kept only if its passage has it word for word; evidence whose passage isn't there is dropped.
    """
    told = signals.join(F.broadcast(checks), "check_id")
    own = told.withColumn("finding_id", F.concat_ws(":", "check_id", F.coalesce(F.get("evidence", F.lit(0)).cast("string"), F.lit("page"))))
    shown = own.select("page_id", "finding_id", F.posexplode("evidence").alias("nth", "passage_ord")).join(passages.select("page_id", "passage_ord", "text"), ["page_id", "passage_ord"])
    said = shown.withColumn("quote", T.quote(F.col("text"))).where(T.is_quoted(F.col("text"), F.col("quote")))
    quotes = said.groupBy("page_id", "finding_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "quote"))), lambda x: x["quote"]).alias("quotes"))
    joined = own.join(quotes, ["page_id", "finding_id"], "left").where((F.size("evidence") == 0) | F.col("quotes").isNotNull())
    return joined.select("page_id", "finding_id", "check_id", "module", "priority", "tier", F.lit("page").alias("ref"), T.filled(F.col("observation"), F.col("slots")).alias("observation"), F.coalesce("quotes", F.array().cast("array<string>")).alias("quotes"), F.lit("high").alias("confidence"))


def from_triggers(fired: DataFrame, checks: DataFrame) -> DataFrame:
    """Findings of decide.triggered(), with the banded confidence."""
    told = fired.join(F.broadcast(checks), "check_id")
    slots = F.create_map(F.lit("label"), F.coalesce("label", F.lit("Untitled section")))
    return told.select("page_id", F.concat_ws(":", "check_id", "ref_id").alias("finding_id"), "check_id", "module", "priority", "tier", F.when(F.col("scope") == "section", F.col("ref_id")).otherwise("page").alias("ref"), T.filled(F.col("observation"), slots).alias("observation"), F.array().cast("array<string>").alias("quotes"), T.banded(F.col("confidence")).alias("confidence"))


def evidence(passages: DataFrame, least: int = 8, most: int = 2) -> DataFrame:
    """page_id, ref_id, quotes: the first passages of each ref that have enough words, from page_id, ref_id, passage_ord, text.

    What is cut to a quote must still have the words. Refs without such a passage have no row."""
    said = passages.withColumn("quote", T.quote(F.col("text"))).where((F.size(F.split("quote", r"\s+")) >= least) & T.is_quoted(F.col("text"), F.col("quote")))
    own = Window.partitionBy("page_id", "ref_id").orderBy("passage_ord")
    first = said.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most)
    return first.groupBy("page_id", "ref_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "quote"))), lambda x: x["quote"]).alias("quotes"))


def from_decisions(fired: DataFrame, checks: DataFrame, subsumes: DataFrame, passages: DataFrame) -> DataFrame:
    """from_triggers() with evidence() of their refs, without subsumed and repeated ones. No evidence, no finding."""
    quoted = from_triggers(fired, checks).drop("quotes").withColumn("ref_id", F.substring_index("finding_id", ":", -1))
    return first_of_evidence(without_subsumed(quoted.join(evidence(passages), ["page_id", "ref_id"]).drop("ref_id"), subsumes))


def told(rows: DataFrame, checks: DataFrame, ident: Column, slots: dict[str, Column], quotes: Column | None = None) -> DataFrame:
    """Findings of rows that have a check_id and a confidence; ident ends their ids, slots fill the checks' texts."""
    none = F.array().cast("array<string>")
    filled = T.filled(F.col("observation"), F.create_map(*[x for k, v in slots.items() for x in (F.lit(k), v.cast("string"))]) if slots else F.create_map().cast("map<string,string>"))
    kept = rows.withColumns({"_ident": ident, "_quotes": none if quotes is None else quotes}).join(checks, "check_id")
    return kept.select("page_id", F.concat_ws(":", "check_id", "_ident").alias("finding_id"), "check_id", "module", "priority", "tier", F.lit("page").alias("ref"), filled.alias("observation"), F.col("_quotes").alias("quotes"), "confidence")


def from_messaging(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Findings of report.messaging()."""
    return told(rows, checks, F.lit("page"), {})


def from_irrelevant(rows: DataFrame, checks: DataFrame, passages: DataFrame) -> DataFrame:
    """Findings of report.irrelevant_evidence(), with the claim's passage as quote; without the passage there is none."""
    met = rows.join(passages.select("page_id", "passage_ord", "text"), ["page_id", "passage_ord"]).withColumn("check_id", F.lit("evidence_irrelevant"))
    return told(met, checks, F.col("passage_ord").cast("string"), {"what": F.coalesce(T.claim_subject(F.col("claim")), F.col("claim"))}, F.array(T.quote(F.col("text"))))


def from_coverage(rows: DataFrame, checks: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings of report.page_coverage(): questions that are raised and left open. texts: question_id, question."""
    opened = rows.where("not answered").join(texts, "question_id").withColumn("check_id", F.lit("question_raised_unanswered"))
    return told(opened, checks, F.col("question_id"), {"question": F.col("question")})


def from_focus(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Findings of a page's stated focuses (page_id, focus_id, focus, found, confidence: the answer's) that it doesn't convey."""
    missed = rows.where("not found").withColumns({"check_id": F.lit("focus_not_communicated"), "confidence": T.page_band(F.col("confidence"))})
    return told(missed, checks, F.col("focus_id"), {"focus": F.col("focus")})


def united(*streams: DataFrame) -> DataFrame:
    """All streams' findings in one order. No stream: ValueError."""
    if not streams:
        raise ValueError("no findings to unite")
    return in_order(reduce(DataFrame.unionByName, streams))


def advised(findings: DataFrame, advice: DataFrame) -> DataFrame:
    """findings with why they matter and what to do; null where advice (check_id, why, action) has nothing."""
    return findings.join(advice, "check_id", "left")


def without_subsumed(findings: DataFrame, subsumes: DataFrame) -> DataFrame:
    """Findings but for those that another finding of the same page and ref makes superfluous."""
    losers = findings.select("page_id", "ref", F.col("check_id").alias("winner")).join(F.broadcast(subsumes), "winner").select("page_id", "ref", F.col("loser").alias("check_id")).distinct()
    return findings.join(losers, ["page_id", "ref", "check_id"], "left_anti")


def first_of_evidence(findings: DataFrame) -> DataFrame:
    """One finding of a check for each first quote (or id, without quotes)."""
    own = Window.partitionBy("page_id", "check_id", F.coalesce(F.get("quotes", F.lit(0)), F.col("finding_id"))).orderBy("finding_id")
    return findings.withColumn("nth", F.row_number().over(own)).where("nth = 1").drop("nth")


def in_order(findings: DataFrame) -> DataFrame:
    """findings with place: by tier, occurrences of the check on the page (most first), confidence, check and id."""
    counted = findings.withColumn("occurrences", F.count("*").over(Window.partitionBy("page_id", "check_id")))
    sure = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    own = Window.partitionBy("page_id").orderBy("tier", F.desc("occurrences"), sure, "check_id", "finding_id")
    return counted.withColumn("place", F.row_number().over(own))


def summary(findings: DataFrame) -> DataFrame:
    of = lambda p: F.count_if(F.col("priority") == p)
    return findings.groupBy("page_id").agg(F.count("*").alias("n"), of("high").alias("high"), of("medium").alias("medium"), of("low").alias("low"))


def module_counts(findings: DataFrame) -> DataFrame:
    """page_id, module, n and place: findings by module, in the order in which modules are read; unknown ones come last."""
    counts = findings.groupBy("page_id", "module").agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*[F.lit(m) for m in rules.MODULES]), F.col("module"))
    own = Window.partitionBy("page_id").orderBy(F.when(at > 0, at).otherwise(len(rules.MODULES) + 1), "module")
    return counts.withColumn("place", F.row_number().over(own))


def verified(quotes: DataFrame) -> DataFrame:
    """quotes (text, quote, ...) whose text has them, in Unicode's composed form and with like white space."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return quotes.where(T.is_quoted(composed(F.col("text")), composed(F.col("quote"))))


def without_banned_keys(df: DataFrame, banned: tuple[str, ...]) -> DataFrame:
    """df itself; ValueError if its schema has one of the keys at any depth, but for a score among decisions."""
    from pyspark.sql import types as S

    def walk(kind: S.DataType, path: str) -> None:
        if isinstance(kind, S.StructType):
            for f in kind.fields:
                if f.name in banned and not (f.name == "score" and "decisions" in path):
                    raise ValueError(f"no overall grade is reported: {path}.{f.name}")
                walk(f.dataType, f"{path}.{f.name}")
        elif isinstance(kind, S.ArrayType):
            walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, S.MapType):
            walk(kind.valueType, f"{path}{{}}")

    walk(df.schema, "result")
    return df

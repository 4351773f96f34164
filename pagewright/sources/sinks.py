"""Reports as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown(lines: DataFrame, by: str) -> DataFrame:
    """A report for each value of `by`: a heading and its lines (ord, line) in order; pages is their number."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return lines.groupBy(by).agg(F.count("*").alias("pages"), F.concat(F.lit("# "), F.col(by), F.lit("\n"), F.array_join(rows, "\n")).alias("report"))


def finding_lines(findings: DataFrame) -> DataFrame:
    """Findings in their place as numbered lines with their quotes: page_id, ord, line."""
    quoted = F.array_join(F.transform("quotes", lambda q: F.concat(F.lit("\n> "), q)), "")
    return findings.select("page_id", F.col("place").alias("ord"), F.concat(F.col("place").cast("string"), F.lit(". ["), "priority", F.lit("] "), "observation", quoted).alias("line"))


def file_name(host, scope: str, day):
    """Name of an exported report: host, scope and audit day."""
    return F.concat_ws("-", F.regexp_replace(host, "[^a-zA-Z0-9.]+", "-"), F.lit(scope), F.date_format(day, "yyyy-MM-dd"))


FINDING = ("check_id", "module", "priority", "confidence", "observation", "quotes", "why", "action")
NOTHING = "Nothing to mend was found on this page."


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page_reports(pages: DataFrame, findings: DataFrame, kind: str = "markdown") -> DataFrame:
    """One report for each page (page_id, url, title), also for those without findings: page_id, name (of a file) and content.

    findings as audit.report(): place orders them; null why and action are left out. kind: markdown, json (one object) or html,
    in which all that pages say is escaped. A null title is the url. Repeated pages have a report each.
    """
    if kind not in ("markdown", "json", "html"):
        raise ValueError(f"no such report: {kind}")
    each = findings.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", *FINDING))).alias("fs"))
    rows = pages.select("page_id", "url", F.coalesce("title", "url", F.lit("")).alias("title")).join(each, "page_id", "left")
    fs = F.coalesce("fs", F.array().cast(dict(each.dtypes)["fs"]))
    rows = rows.withColumn("fs", fs)
    if kind == "json":
        of = F.transform("fs", lambda f: F.struct(*[f[c].alias(c) for c in FINDING]))
        content = F.to_json(F.struct("url", "title", of.alias("findings")))
    elif kind == "markdown":
        said = lambda f: F.concat(
            F.lit("\n\n### "), f["place"].cast("string"), F.lit(". "), f["observation"], F.lit("\n\nPriority: "), f["priority"], F.lit(", confidence: "), f["confidence"], F.coalesce(F.concat(F.lit("\n\n"), f["why"]), F.lit("")),
            F.coalesce(F.concat(F.lit("\n\nTo do: "), f["action"]), F.lit("")), F.array_join(F.transform(f["quotes"], lambda q: F.concat(F.lit("\n\n> "), F.replace(q, F.lit("\n"), F.lit("\n> ")))), ""),
        )
        body = F.when(F.size("fs") == 0, "\n\n" + NOTHING).otherwise(F.array_join(F.transform("fs", said), ""))
        content = F.concat(F.lit("# "), "title", F.lit("\n\n"), F.coalesce("url", F.lit("")), F.lit("\n\n## Findings ("), F.size("fs").cast("string"), F.lit(")"), body, F.lit("\n"))
    else:
        quoted = lambda f: F.array_join(F.transform(f["quotes"], lambda q: F.concat(F.lit("<blockquote>"), _escaped(q), F.lit("</blockquote>"))), "")
        said = lambda f: F.concat(F.lit("<li><p>"), _escaped(f["observation"]), F.lit("</p>"), quoted(f), F.coalesce(F.concat(F.lit("<p>"), _escaped(f["action"]), F.lit("</p>")), F.lit("")), F.lit("</li>"))
        body = F.when(F.size("fs") == 0, f"<p>{NOTHING}</p>").otherwise(F.concat(F.lit("<ol>"), F.array_join(F.transform("fs", said), ""), F.lit("</ol>")))
        content = F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), _escaped(F.col("title")), F.lit("</title><h1>"), _escaped(F.col("title")), F.lit("</h1><p>"), _escaped(F.coalesce("url", F.lit(""))), F.lit("</p>"), body, F.lit("\n"))
    ending = {"markdown": "md", "json": "json", "html": "html"}[kind]
    return rows.select("page_id", F.concat_ws("", F.lit("page-"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(f".{ending}")).alias("name"), content.alias("content"))

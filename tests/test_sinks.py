"""Reports of pages, and the data source that writes them as files."""

import json

import pytest
from pagewright.sources import sinks
from pagewright.sources.files import FileSet
from pyspark.sql import functions as F

FOUND = "page_id long, place int, check_id string, module string, priority string, confidence string, observation string, quotes array<string>, why string, action string"


@pytest.fixture(scope="module")
def reports(spark):
    pages = spark.createDataFrame([(1, "https://e.com/a?x=1&y=2", "A <b> & \"c\""), (2, "https://e.com/b", None), (None, None, None)], "page_id long, url string, title string")
    found = spark.createDataFrame([
        (1, 2, "b", "m", "low", "medium", "Second.", [], None, None), (1, 1, "a", "m", "high", "high", "Said <script>.", ["one\ntwo", "& three"], "Why?", "Do it."), (9, 1, "a", "m", "high", "high", "Of no page.", [], None, None),
    ], FOUND)
    return lambda kind: {r["page_id"]: (r["name"], r["content"]) for r in sinks.page_reports(pages, found, kind).collect()}


def test_markdown(reports):
    got = reports("markdown")
    assert set(got) == {1, 2, None}
    assert got[1] == ("page-1.md", '# A <b> & "c"\n\nhttps://e.com/a?x=1&y=2\n\n## Findings (2)\n\n### 1. Said <script>.\n\nPriority: high, confidence: high\n\nWhy?\n\nTo do: Do it.\n\n> one\n> two\n\n> & three\n\n### 2. Second.\n\nPriority: low, confidence: medium\n')
    assert got[2] == ("page-2.md", f"# https://e.com/b\n\nhttps://e.com/b\n\n## Findings (0)\n\n{sinks.NOTHING}\n") and got[None][0] == "page-none.md"


def test_json_and_html(reports):
    got = reports("json")
    one = json.loads(got[1][1])
    assert got[1][0] == "page-1.json" and [f["check_id"] for f in one["findings"]] == ["a", "b"] and one["findings"][0]["quotes"] == ["one\ntwo", "& three"] and json.loads(got[2][1])["findings"] == []
    html = reports("html")[1][1]
    assert "<script>" not in html and "&lt;script&gt;" in html and "x=1&amp;y=2" in html and html.index("Said") < html.index("Second")
    with pytest.raises(ValueError, match="report"):
        reports("pdf")


def files(place):
    return sorted(p.name for p in place.rglob("*") if p.is_file())


def test_a_file_for_each_row(spark, tmp_path):
    spark.dataSource.register(FileSet)
    df = spark.range(40).select(F.concat(F.lit("r"), F.col("id").cast("string"), F.lit(".md")).alias("name"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("content")).repartition(4)
    place = tmp_path / "out"
    df.write.format("file_set").mode("append").save(str(place))
    assert files(place) == sorted(f"r{k}.md" for k in range(40)) and not (place / "_staged").exists()
    assert {p.read_text() for p in place.rglob("*.md")} == {f"é {k}" for k in range(40)}
    df.limit(2).write.format("file_set").mode("append").save(str(place))  # added beside, nothing is written over
    assert len(files(place)) == 42


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(FileSet)
    names = spark.range(40).select(F.when(F.col("id") == 33, F.lit("../x")).otherwise(F.concat(F.lit("r"), F.col("id").cast("string"))).alias("name"), F.lit("x").alias("content")).repartition(4)
    with pytest.raises(Exception, match="no name for a file"):
        names.write.format("file_set").mode("append").save(str(tmp_path / "out"))
    assert files(tmp_path) == []
    with pytest.raises(Exception, match="added to"):
        names.write.format("file_set").mode("overwrite").save(str(tmp_path / "out"))

"""Queries on small tables made for them, held against their SQL."""

import importlib
from collections import Counter

import duckdb
import pytest

from pagewright.operators import intake, report


@pytest.fixture
def differences(spark, tmp_path):
    """Rows of a query's SQL that the query lacks, and rows it has too many, on tables of (rows, schema) by name."""

    def get(name, **tables):
        entry, db = importlib.import_module("__spark_entry__"), duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df, rel = entry.queries()[name](spark, str(tmp_path)), db.sql(entry.oracle_sql()[name])
        want = Counter(tuple(dict(zip(rel.columns, r))[c] for c in df.columns) for r in rel.fetchall())
        got = Counter(tuple(r) for r in df.collect())
        return list((want - got).elements()), list((got - want).elements())

    return get


def test_focus_lines_keep_the_digits_of_their_places(differences):
    rows = [(1, "0 lines in it\n  some words 1\n\n3 more words 3 \nfour"), (2, None), (3, "short\n1234567 1\n")]
    assert differences("p41_focus_lines", documents=(rows, "doc_id long, text string")) == ([], [])


def test_pages_with_one_address_have_an_order(spark):
    rows = [(n, "a.example", "https://a.example/x", 1, 2) for n in (7, 3, 9, 1)]
    pages = spark.createDataFrame(rows, "page_id long, site string, url string, high int, findings int").coalesce(1)
    assert [(r["page_id"], r["place"]) for r in report.page_table(pages).orderBy("place").collect()] == [(1, 1), (3, 2), (7, 3), (9, 4)]


def test_replay_tells_states_of_one_key_apart(differences):
    rows = [(59351, 0, "eefa42"), (356472, 0, "1cc772"), (515643, 0, "de374f"), (153613, 0, "523c4c"), (3, 0, "said twice"), (3, 0, "said twice")]  # the first two have one key, as have the next two
    assert differences("s10_j16_replay", conversations=(rows, "conv_id long, turn long, text string")) == ([], [])


def test_sitemaps_in_parts_have_one_numbering(differences):
    ids = [9000, 4095, 4096, 0, 8191, 8192, 20000]
    rows = [(k, f"https://{h}.example/p/{k}?a=1&b=<{k}>") for k in ids for h in ("a", "b") if h == "a" or k > 4095]
    assert differences("s05_s06_sitemaps", pages=(rows, "page_id long, url string")) == ([], [])


def test_the_kind_of_a_sitemap_is_looked_for_once(spark):
    maps = spark.createDataFrame([(1, "<sitemapindex><loc>a</loc><loc>b</loc>"), (2, "<loc>c</loc>"), (3, "none"), (4, None)], "k int, body string")
    found = intake.sitemap_urls(maps)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "index", 0, "a"), (1, "index", 1, "b"), (2, "urlset", 0, "c")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sitemapindex" not in plan[: plan.index("Generate")]  # above the explosion it would be once an entry

"""Registered queries: names, schemas and a few runs; all are held against their SQL elsewhere."""

import importlib
import re

import duckdb
import pytest


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


def test_registry(entry):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in queries)


def test_flagship(entry, spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"page_id", "check_id", "place"} <= set(df.columns)


@pytest.mark.parametrize("name", ["d01_passages", "j03_w03_claims", "w07_chunks", "d10_decision_findings", "d19_a18_a20_opportunities", "s03_s04_robots"])
def test_against_sql(entry, spark, sf, name):
    db = duckdb.connect()
    for t in ("pages", "documents", "conversations", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted(repr([dict(zip(rel.columns, r))[c] for c in cols]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want

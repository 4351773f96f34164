"""All queries of the page operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fetch_queries, page_queries, report_queries, request_queries, site_queries, text_queries  # noqa: F401 - they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all pages, in order."""
    from pagewright.operators import audit

    return audit.findings(spark.read.parquet(f"{sf_dir}/pages.parquet"))

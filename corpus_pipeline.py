"""The corpus pipeline: documents of a known language, one of each group of near-duplicates, without secrets, mixed to the
sources' target weights, and encoded as tokens.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a DataFrame; all but the last
return the columns of documents. SQL can express neither cross-parsing nor the components, so there is no ORACLE_SQL; the
tests hold run() against a plain Python version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import bpe, langid, mixing, secrets, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null texts and texts without letters go."""
    return langid.recognised(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near-duplicates."""
    return simhash.one_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a marker."""
    return secrets.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for a document and epoch."""
    return mixing.mixed(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, their number and digest, and the digest of what they decode to."""
    return bpe.encode_column(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_duplicates", without_near_copies),
    ("secrets", without_secrets),
    ("mix", mixed_sources),
    ("tokens", as_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared checkpoint folder and read by the next."""
    from pagewright.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else written(docs), sf_dir)
    return docs

"""The queries that apply each operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binpack, bpe, infill, interaction, langid, mixing, passages, quality, secrets, simhash, telephony, toxicity, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.store_texts(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "action string, host string, path string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(table(spark, sf_dir, "documents"))


def op12_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_documents(table(spark, sf_dir, "documents"))


def op13_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.filter_orders(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the package, which doesn't need it

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_telephony, op3_secrets, op4_passages, op5_mix_sources, op6_bpe, op7_language, op8_simhash, op9_quality, op10_url_filter, op11_fill_in_middle, op12_pack_sequences, op13_filter_orders, pipeline)}


def oracle_sql() -> dict[str, str]:
    """The pipeline's SQL, if there is any, is corpus_pipeline.ORACLE_SQL."""
    return {"op10_url_filter": urls.SQL, "op11_fill_in_middle": infill.SQL, "op13_filter_orders": interaction.SQL}

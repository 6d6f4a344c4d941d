"""The queries of this folder's operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, mixing, quality, simhash, suffix_dedup, telephony, token_store, toxicity, warc, wrapper
from .common import read_table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read_table(spark, sf_dir, "documents")).drop("row_hash")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_documents(spark, read_table(spark, sf_dir, "documents"), vocabulary_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.features(telephony.store(read_table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(read_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mix_sources, op2_suffix_dedup, op3_warc, op4_token_store, op5_quality, op6_telephony, op7_decontaminate, op8_toxicity, op9_main_text, op10_simhash)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE, "op3_warc": warc.ORACLE, "op7_decontaminate": decontam.ORACLE}

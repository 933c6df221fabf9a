"""Queries opN_<name> over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import licenses, mixing, sql
from codeloom.llm.common import table
from codeloom.llm.decontam import find_leaks
from codeloom.llm.lpf import remove_repeats
from codeloom.llm.quality import judge
from codeloom.llm.secrets import scan_secrets
from codeloom.llm.simhash import simhash_groups
from codeloom.llm.tokens import materialise_training_order
from codeloom.llm.toxicity import score_documents
from codeloom.llm.warc import archive_pages


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise_training_order(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")  # a source stands for an owner, its documents of a language for a repository
    return scan_secrets(docs.withColumn("repository", F.concat_ws("/", "source", "lang")), "repository", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_simhash": op4_simhash,
        "op5_token_shards": op5_token_shards,
        "op6_decontamination": op6_decontamination,
        "op7_mixing": op7_mixing,
        "op8_licenses": op8_licenses,
        "op9_quality": op9_quality,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": sql.op1(),
        "op7_mixing": mixing.ORACLE.format(docs="documents"),
        "op8_licenses": sql.op8(),
        "op9_quality": sql.op9(),
        "op10_secrets": sql.op10(),
    }

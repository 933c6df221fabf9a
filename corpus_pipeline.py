"""The corpus pipeline: toxic documents go, near copies go, benchmark leaks go, sources are mixed, and the rest becomes token shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept, which is written as Parquet and read again. All
but the last return the columns of documents. No stage loses a row to a null, empty, repeated or very long text but by its own rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import materialize, table
from codeloom.llm.decontam import drop_leaks
from codeloom.llm.mixing import mix_sources
from codeloom.llm.simhash import drop_near_copies
from codeloom.llm.tokens import materialise_training_order
from codeloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts to be toxic go (operator 3)."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of about 0.8 or more (operator 4)."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go (operator 6)."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to equal weights (operator 7). A document occurs as often as it was drawn."""
    return mix_sources(docs).select(*docs.columns)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training-order shards of token ids, one row for each sequence (operator 5)."""
    return materialise_training_order(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_shards", token_shards),
]

#: A fitted model and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality, exact copies, near copies, mix, packing, each stage on all that the one before kept.

Edge cases, in every stage: a null text counts as empty and is a document like any other; a null doc_id stays null; repeated
rows are copies of each other for the copy stages and documents of their own for the others; an empty table gives an empty
table; further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.llm import chunk_dedup, mixing, ngram_join, packing, quality_rules
from gridweave.llm.common import Workspace, documents, temporary_tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels of this input, doesn't reject."""
    ensemble = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.score_documents(docs, ensemble).where("predicted = 1").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return chunk_dedup.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: word 5-grams, similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.digest(packing.pack(docs, packing.tokenizer_path()))


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mix", mix), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for at, (_, stage) in enumerate(STAGES):
        with temporary_tables():  # what a stage wrote for itself goes once its result is written
            docs = work.write(stage(spark, docs, sf_dir), f"stage-{at}")
        work.drop(f"stage-{at - 1}")
    return docs

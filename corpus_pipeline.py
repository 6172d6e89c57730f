"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import mixture, parity_join, repetition, simple8b, templates
from textloom.llm.shared import Tables, made, sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves too much go."""
    return repetition.keep_unrepetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return parity_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, reworded or not, go."""
    return templates.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents are drawn at their weights and shuffled into shards."""
    return mixture.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as packed token ids: (doc_id, n_ids, words, blocks)."""
    return simple8b.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Suffix arrays, hypergeometric draws and packed words have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Nulls, empty texts, repeated rows and empty tables are each stage's to handle, as its operator says."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        since = made()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = tables.write(docs, name)
            # written, so neither what the stage read nor what it put aside is needed any more
            sweep(spark, since)
            if k:
                tables.drop(STAGES[k - 1][0])
    return docs

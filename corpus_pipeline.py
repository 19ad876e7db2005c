"""The corpus pipeline: documents in, packed sequences out. Each stage calls one operator of tessella.llm.

toxicity and quality drop the documents they reject, neardup keeps one document of each group, mixing gives the words
that the mix takes of each document (a row for each epoch of it), packing gives the pieces of the final sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import kneserney, mixing, packing, simhash, toxicity
from tessella.llm.common import delete, fresh, scope, table
from tessella.plans.session import ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, table(ship(spark), sf_dir, "labels")))


def without_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneserney.kept_only(docs, kneserney.train(docs, table(ship(spark), sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.without_near_duplicates(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.packing(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", without_junk),
    ("neardup", without_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]
#: Trained models, fingerprint components and a genetic algorithm: SQL can't express them. Tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the final sequences. What a stage wrote for itself goes when its result is written, and that when the next one's is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh(spark, f"stage-{name}")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

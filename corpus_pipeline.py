"""From raw documents to packed training sequences, in five stages that each write their result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.llm import language_id, mixing, packing, secret_scan, simhash
from statuta.llm.registry import VOCABULARY
from statuta.session import cut_lineage

#: Toxic text gets no share of the mixture; the other domains keep the tokens they have.
TARGETS = {"toxic": 0.0}


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is named with certainty; the model learns from the rows not held out."""
    return language_id.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id."""
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask."""
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates ask for: toxic ones go, the others stay."""
    return mixing.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens, next to their lexical neighbours."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("language_id", identify),
    ("near_duplicates", deduplicate),
    ("secrets", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: Training and packing cannot be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

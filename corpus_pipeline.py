"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept, as Parquet: toxic documents go, one
document of each near-duplicate group stays, documents that hold a benchmark
item go, secrets are masked in the text, and what is left is packed.

Defined results: a null text counts as empty; a document without text passes every filter and ends at
packing, as it holds nothing; of equal rows one stays, of an id with several texts each that is no
duplicate of another; rows without id are filtered like any other; without labels of both kinds
nothing is toxic; a null source is one unnamed repository; very long texts are read whole; an empty
table gives empty stages; columns beyond those of documents are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, minhash, packing, secrets, toxicity
from lodestone.llm.common import cut, read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier chain, fitted on the labelled ones, rejects."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each near-duplicate group (five words, 0.8)."""
    return minhash.keep_first(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item or a slightly edited one."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask credentials in the text, save those that many owners carry; every document stays."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left: one row per sequence, with its documents in order and their (masked) bytes."""
    return packing.filled(docs, packing.plan(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: classifier, embedding walk and greedy packing are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name, keep=True)
    return docs
